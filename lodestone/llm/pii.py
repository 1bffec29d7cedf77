"""Personal data by bootstrapped contextual extraction.

Seeds are the entities of fixed patterns (e-mail, IP, card, phone) and tokens that look like keys (long, letters and digits
mixed). A seed's lexical patterns are what stands around it: the word before if it ends in a mark such as a colon, the
two and the three words before, and the word before with the word after. Identifier-like tokens (six characters, a digit at
least) in such places are instances. Patterns and instances form a graph that Spark scores in rounds: a pattern's confidence
is the summed confidence of its instances over all places in all texts where it stands around any word; an instance is as
sure as the chance that one of its confident patterns is right, and sure instances are seeds of the next round, so their
other patterns come into play. The rounds end when no pattern and no instance is added. Confident patterns then extract
identifiers (kind `id`); a key without such a pattern is none. Base spans stay as they are.

Defined cases: null and empty texts have no spans. Repeated rows give a row each (and count once per row in the
statistics); extra columns are ignored. Offsets are code points, end exclusive.
"""

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import free_name, read, small, written

KINDS = ("email", "ip", "card", "phone", "id")
MIN_SEEDS = 3  #: distinct seeds that a pattern needs
CONFIDENCE = 0.8
PATTERNS_AT_ONCE = 200_000  #: patterns that one pass over the texts counts or applies; more take more passes
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only begin where its digits begin
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_KEY = re.compile(r"(?=(?:[^0-9]*[0-9]){4})(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9_+/=-]{20,}")
_DIGITS = re.compile(r"[0-9]+")
_MARKS = "\"'`.,;:!?()[]{}<>=#$%&*|"


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    twice = "0246813579"
    return sum(int(d) for d in digits[::-2]) % 10 == -sum(int(twice[int(d)]) for d in digits[-2::-2]) % 10


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind as listed."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) < 3 or len(p.lstrip("0")) == 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Identifier-like tokens outside the base spans."""
    out, end, n = [], 0, len(text)
    for m in _DIGITS.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end < n and not text[end].isspace():
            end += 1
        s, e = start, end
        while s < e and text[s] in _MARKS:
            s += 1
        while e > s and text[e - 1] in _MARKS:
            e -= 1
        if e - s >= 6 and not any(b < e and s < f for _, b, f in base):
            out.append((s, e))
    return out


def _word_before(text: str, at: int) -> tuple[str, int]:
    end = at
    while end > 0 and text[end - 1].isspace():
        end -= 1
    start = end
    while start > 0 and not text[start - 1].isspace():
        start -= 1
    return text[start:end].lower(), start


def _word_after(text: str, at: int) -> str:
    n = len(text)
    while at < n and not text[at].isspace():
        at += 1  # marks that cling to the token
    while at < n and text[at].isspace():
        at += 1
    end = at
    while end < n and not text[end].isspace():
        end += 1
    return text[at:end].lower()


def around(three: str, two: str, one: str, after: str) -> list[str]:
    """The patterns of a place with these words before it and this one after it; empty ones are missing."""
    out = [one] if one[-1] in ":=#" else []
    if two:
        out.append(f"{two} {one}")
    if three:
        out.append(f"{three} {two} {one}")
    if after:
        out.append(f"{one} _ {after}")
    return out


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """The patterns of a span; none at the text's start."""
    while start > 0 and not text[start - 1].isspace():
        start -= 1  # marks that cling to the token
    one, at = _word_before(text, start)
    if not one:
        return []
    two, at = _word_before(text, at)
    return around(_word_before(text, at)[0] if two else "", two, one, _word_after(text, end))


def _instances(df: DataFrame) -> DataFrame:
    """(pattern, instance, seed, n) of base entities and candidates."""

    def run(batches):
        for b in small(batches):
            seen: Counter = Counter()
            for text in b.column(0).to_pylist():
                base = base_spans(text) if text else []
                for s, e, seed in [(s, e, True) for _, s, e in base] + [(s, e, False) for s, e in (candidates(text, base) if text else [])]:
                    token = text[s:e]
                    seed = seed or bool(_KEY.fullmatch(token))
                    for p in patterns_of(text, s, e):
                        seen[p, token, seed] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64())], ["pattern", "instance", "seed", "n"])

    return df.select("text").mapInArrow(run, "pattern string, instance string, seed boolean, n long").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))


def _last(pattern: str) -> str:
    """The word right before the place."""
    return pattern.partition(" _ ")[0].rpartition(" ")[2]


def _places(df: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, places): how often the pattern stands around any word."""
    shared = df.sparkSession.sparkContext.broadcast((frozenset(patterns), frozenset(map(_last, patterns))))

    def run(batches):
        known, last = shared.value
        for b in small(batches):
            seen: Counter = Counter()
            for text in b.column(0).to_pylist():
                words = text.lower().split() if text else []
                n = len(words)
                for i in [i for i, w in enumerate(words) if w in last]:
                    if i + 1 < n:
                        seen.update(p for p in around(words[i - 2] if i > 1 else "", words[i - 1] if i else "", words[i], words[i + 2] if i + 2 < n else "") if p in known)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["pattern", "places"])

    return df.select("text").mapInArrow(run, "pattern string, places long").groupBy("pattern").agg(F.sum("places").alias("places"))


def passes(patterns: DataFrame) -> int:
    """How many lists of about PATTERNS_AT_ONCE, which the driver and a task hold at once, the patterns make."""
    return -(-patterns.count() // PATTERNS_AT_ONCE)


def nth(patterns: DataFrame, i: int, n: int) -> list[str]:
    return [r["pattern"] for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == i).select("pattern").collect()]


def learn_patterns(df: DataFrame) -> DataFrame:
    """(pattern, confidence) of the high-confidence patterns."""
    edges = written(_instances(df), "pii_edges")
    # enough instances, one of which shares a pattern with others: what no round can make confident is not counted
    support = written(edges.groupBy("pattern").agg(F.count("*").alias("k")).where(F.col("k") >= MIN_SEEDS).select("pattern"), "pii_patterns")
    counted = None
    n = passes(support)
    for i in range(n):
        more = _places(df, nth(support, i, n))
        counted = more if counted is None else counted.union(more)
    if counted is None:
        return support.select("pattern", F.lit(1.0).alias("confidence"))
    edges = written(edges.join(counted, "pattern"), "pii_graph")
    scores = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("s"))
    before = (-1, -1)
    while True:
        weighed = edges.join(scores, "instance").groupBy("pattern").agg((F.sum(F.col("n") * F.col("s")) / F.max("places")).alias("c"), F.count_if(F.col("s") >= CONFIDENCE).alias("seeds"))
        sure = (F.col("c") >= CONFIDENCE) & (F.col("seeds") >= MIN_SEEDS)
        confident = written(weighed.where(sure).select("pattern", F.least("c", F.lit(1.0)).alias("confidence")), "pii_confident")
        reach = edges.join(confident, "pattern", "left").groupBy("instance").agg(F.max("seed").alias("seed"), F.sum(F.when(F.col("confidence").isNull(), 0.0).otherwise(F.log1p(-F.least("confidence", F.lit(0.999))))).alias("miss"))
        scores = written(reach.select("instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("miss")).alias("s")), "pii_scores")
        now = (confident.count(), scores.where(F.col("s") >= CONFIDENCE).count())
        if now <= before:  # both only grow
            return confident
        before = now


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_spans(df: DataFrame, patterns: list[str], keep: list[str], name: str = "spans", base: bool = True) -> DataFrame:
    """The columns `keep`, with `name` (SPANS) by start, then kind as listed; without base only what the patterns extract."""
    shared = df.sparkSession.sparkContext.broadcast(frozenset(patterns))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        known = shared.value
        for b in small(batches):
            out = []
            for text in b.column(at).to_pylist():
                fixed = base_spans(text) if text else []
                more = [("id", s, e) for s, e in candidates(text, fixed) if not known.isdisjoint(patterns_of(text, s, e))] if known and text else []
                out.append([{"kind": k, "start": s, "end": e} for k, s, e in sorted(fixed * base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, kind)], [*keep, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + f", `{name}` {SPANS}"
    at = keep.index("text") if "text" in keep else len(keep)
    return df.select(*keep, *([] if at < len(keep) else [F.col("text").alias(free_name(df, "__text"))])).mapInArrow(run, schema)


def detect(df: DataFrame, keep: list[str], name: str = "spans") -> DataFrame:
    """Learns the patterns on all of df and returns `keep` with the spans of every text."""
    confident = learn_patterns(df)
    n = passes(confident)
    if n <= 1:
        return find_spans(df, nth(confident, 0, n) if n else [], keep, name)
    columns = [*keep, *([] if "text" in keep else ["text"])]
    out, extra = find_spans(df, nth(confident, 0, n), columns, name), free_name(df.withColumn(name, F.lit(0)), "__more")
    rank = F.array(*[F.lit(k) for k in KINDS])
    by_start = lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))
    back = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    for i in range(1, n):
        out = find_spans(out, nth(confident, i, n), out.columns, extra, False)
        merged = F.array_distinct(F.concat(name, extra))
        out = out.withColumn(name, F.transform(F.array_sort(F.transform(merged, by_start)), back)).drop(extra)
    return out.select(*keep, name)


def mask(text, spans):
    """The text with each span (overlapping ones joined) replaced by its kind in angle brackets. Columns in, column out."""
    start = F.transform(spans, lambda s: s["start"])
    # spans are sorted by start: one is swallowed if an earlier one reaches beyond its start
    tops = F.transform(spans, lambda s, i: F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda t: t["end"])), F.lit(0)))
    pieces = F.transform(spans, lambda s, i: F.concat(F.when(s["start"] >= F.get(tops, i), F.concat(F.substring(text, F.get(tops, i).cast("int") + 1, (s["start"] - F.get(tops, i)).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")))
    last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    return F.when(F.size(start) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), F.substring(text, last.cast("int") + 1, F.lit(2**31 - 1))))


def _only(kind: str):
    return lambda x: F.when(x == kind, x).otherwise("")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in every document."""
    docs = read(spark, sf_dir, "documents")
    found = detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])

    def joined(s):
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, _only(k)), "")).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda x: x["kind"] != "id")
    return found.select("doc_id", *counts[:4], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), counts[4])
