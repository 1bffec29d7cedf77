"""Licence scans: a generalised suffix automaton of licence texts, matching statistics, chained spans.

The automaton holds every substring (in words) of the templates: whole licence texts and one-line notices. Each file's words are
streamed through it; at every word the matching statistic and the suffix links below it give, for each place of each
template, how many words up to here stand there too. A match that grows no further, of MIN_MATCH words at least, is an anchor.
Anchors of one template are chained by dynamic programming (text and template positions rise, gaps of MAX_GAP words at
most, overlaps count once), so any number of chains is open and every place of a template may be used; a chain that covers
MIN_COVER of its template (all of a short one) becomes a span with that template's label, unless another covers more there.

Defined cases: a null or empty text has no words, no places, null first_word and last_word, empty labels and score 0.
Repeated rows each give a row; extra columns are ignored; no text is cut.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import read, small, texts
from lodestone.llm.licence_texts import NOTICES, TEXTS

# The contract's phrases and labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

TEMPLATES = [*TEXTS, *NOTICES]

MIN_MATCH = 3  #: words of a match that may start or extend a chain
MAX_GAP = 4  #: words between two matches of a chain, in the text and in the template
MIN_COVER = 0.6  #: share of the template's words that a chain must cover
WHOLE = 20  #: words under which a template must be covered whole
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; separators are ASCII, so bytes serve."""
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Online construction over several word sequences; each state knows one (template, end) occurrence per template."""

    def __init__(self, templates: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, seq in enumerate(templates):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w)
                self.ends[last].add((t, i))
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, p: int, w: bytes) -> int:
        if w in self.next[p]:
            q = self.next[p][w]
            return q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        new = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def matches(self, seq: list[bytes]) -> list[tuple[int, int, int]]:
        """Maximal matches (end, length, state): where the statistic does not grow with the next word."""
        out, s, n, known, links, edges, length = [], 0, 0, self.next[0], self.link, self.next, self.length
        for i, w in enumerate(seq):
            if n == 0 and w not in known:
                continue
            if w in edges[s]:
                s, n = edges[s][w], n + 1
                continue
            if n >= MIN_MATCH:
                out.append((i - 1, n, s))
            while s > 0 and w not in edges[s]:
                s = links[s]
                n = length[s]
            s, n = (edges[s][w], n + 1) if w in edges[s] else (0, 0)
        if n >= MIN_MATCH:
            out.append((len(seq) - 1, n, s))
        return out

    def anchors(self, seq: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(template, end in it, end in the text, words) of every match that grows no further, by end in the text."""
        out, s, n, known, links, edges, length = [], 0, 0, self.next[0], self.link, self.next, self.length
        here: dict[tuple[int, int], int] = {}
        for i, w in enumerate([*seq, None]):
            if n == 0 and w not in known:
                continue
            while s > 0 and w not in edges[s]:
                s = links[s]
                n = length[s]
            s, n = (edges[s][w], n + 1) if w in edges[s] else (0, 0)
            before, here = here, {}
            at, size = s, n
            while size >= MIN_MATCH:
                for place in self.ends[at]:
                    here.setdefault(place, size)  # the longest first: shorter suffixes hold the same places
                at = links[at]
                size = length[at]
            out += [(t, e, i - 1, k) for (t, e), k in before.items() if here.get((t, e + 1), 0) != k + 1]
        return out


def chains(anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(first word, end word, words covered) of the best disjoint chains of one template's anchors (end in it, end in the text, words),
    by end in the text. Of chains that share text the one that covers more stays."""
    best: list[tuple[int, int]] = []  # words covered by the best chain that ends with each anchor, and where it starts
    ended: list[bool] = []
    low = 0
    widest = max((k for *_, k in anchors), default=0)
    for j, (e, i, k) in enumerate(anchors):
        covered, start, came = k, i - k + 1, -1
        while anchors[low][1] < i - widest - MAX_GAP:
            low += 1
        for m in range(low, j):
            f, h, _ = anchors[m]
            gap, step = i - k - h, e - k - f  # words between the two in the text and in the template, negative if they overlap
            more = k + min(0, gap, step)
            if h < i and f < e and gap <= MAX_GAP and step <= MAX_GAP and more > 0 and (best[m][0] + more, -best[m][1]) > (covered, -start):
                covered, start, came = best[m][0] + more, best[m][1], m
        best.append((covered, start))
        ended.append(True)
        if came >= 0:
            ended[came] = False
    found = sorted((-c, s, anchors[j][1] + 1) for j, (c, s) in enumerate(best) if ended[j])
    out: list[tuple[int, int, int]] = []
    for c, s, e in found:
        if all(e <= a or s >= b for a, b, _ in out):
            out.append((s, e, -c))
    return sorted(out)


class Scanner:
    """Finds base places of the phrases and template spans in one text at a time."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.labels = [label for label, _ in templates]
        seqs = [words(t.encode()) for _, t in templates]
        self.sizes = [len(s) for s in seqs]
        self.automaton = SuffixAutomaton(seqs)

    def base(self, seq: list[bytes]) -> list[tuple[int, str]]:
        have, out = set(seq), []
        for phrase, label in self.phrases:
            if not have.issuperset(phrase):
                continue
            at, first = -1, phrase[0]
            while True:
                try:
                    at = seq.index(first, at + 1)
                except ValueError:
                    break
                if seq[at : at + len(phrase)] == phrase:
                    out.append((at, label))
        return sorted(out)

    def spans(self, seq: list[bytes]) -> list[tuple[int, int, str, float]]:
        """Covered template spans: (first word, end word, label, share of the template covered). Of spans that share text the one with
        more covered words stays, then the one with the larger share of its template."""
        own: dict[int, list] = {}
        for t, e, i, k in self.automaton.anchors(seq):
            own.setdefault(t, []).append((e, i, k))
        least = lambda t: MIN_COVER * self.sizes[t] if self.sizes[t] >= WHOLE else self.sizes[t]
        found = sorted((-c, -c / self.sizes[t], s, e, t) for t, anchors in own.items() for s, e, c in chains(anchors) if c >= least(t))
        out: list[tuple[int, int, int]] = []
        for _, _, s, e, t in found:
            if all(e <= a or s >= b for a, b, _ in out):
                out.append((s, e, t))
        cover = {(s, e, t): -share for _, share, s, e, t in found}
        return sorted((s, e, self.labels[t], min(1.0, cover[s, e, t])) for s, e, t in out)

    def scan(self, text: bytes) -> dict:
        seq = words(text)
        base, spans = self.base(seq), self.spans(seq)
        starts = [at for at, _ in base]
        named = sorted({label for _, label in base})
        every = sorted({*named, *(label for _, _, label, _ in spans)})
        score = max([1.0 * bool(base), *(c for *_, c in spans)])
        return {"n_words": len(seq), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(named), "labels": ",".join(every), "score": score, "spans": spans}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,covered:double>>"


def scan_licenses(df: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document: base places, labels, score and the spans that the automaton found."""

    def run(batches):
        scanner = Scanner(phrases, templates)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.float64())]))
        for b in small(batches):
            rows = [scanner.scan(t) for t in texts(b)]
            cols = [b.column(0)]
            for name, t in (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())):
                cols.append(pa.array([r[name] for r in rows], t))
            cols.append(pa.array([[dict(zip(("start", "end", "label", "covered"), s, strict=True)) for s in r["spans"]] for r in rows], kind))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence places and labels of every document (spans are the operator's own output, left out of the digest)."""
    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")
