"""Byte-level BPE encoding and decoding with a fixed rank file.

Encoding: a fold over each distinct word's byte sequence (Spark higher-order functions) merges, again and again, the adjacent pair
of lowest rank, looked up in a literal rank map; the map is keyed by pairs of ids and split into small maps by a
hash, since Spark searches a map from end to end. Words over LONG bytes, for which the fold would be cubic, are
merged in the task by a heap instead, with the same result. Tasks cut texts into words by the given pattern. The words that
occur most over all texts (at most CACHE, a cache that no result depends on) are folded once and broadcast; every other
word is folded beside the texts it stands in, once a batch. No text is shuffled. Decoding looks up each id's bytes
and concatenates the pieces.

Defined cases: null and empty texts have no ids. Repeated rows give a row each; extra columns are ignored; texts of any length are
encoded whole.
"""

import base64
import heapq
import json
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import partitions, read, small

CACHE = 1 << 18  #: words whose ids are broadcast (about 30 bytes each, some 200 in each Python worker)
BUCKETS = 1 << 16
BATCH = 4_000_000  #: characters whose words are looked up together
LONG = 64  #: bytes; longer words are merged by a heap
_SHIFT = 20


def load_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank (ranks are dense from 0)."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def public_pattern(pattern: str) -> str:
    r"""The pattern for Python's regex, with \s as the Unicode property (Python's own \s has four control characters more)."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bucket(a, b):
    return a * 31 + b


class Merges:
    """Columns that encode words by a literal rank map."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens)}
        maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for t, i in rank.items():
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    maps[_bucket(a, b) % BUCKETS][str(a << 32 | b)] = i
        # from_json of a literal is folded into one literal before the query runs
        self.ranks = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")
        self.bytes = F.from_json(F.lit(json.dumps([rank[bytes([i])] for i in range(256)])), "array<int>")

    def _rank(self, a: Column, b: Column) -> Column:
        key = F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long")).cast("string")
        return F.element_at(F.get(self.ranks, _bucket(a, b).bitwiseAND(F.lit(BUCKETS - 1))), key)

    def _merge(self, ids: Column, _: Column) -> Column:
        ranked = F.transform(F.slice(ids, F.lit(2), F.lit(1 << 30)), lambda x, i: F.shiftleft(self._rank(F.get(ids, i), x).cast("long"), _SHIFT).bitwiseOR(i.cast("long")))
        joined = lambda best: _let(best.bitwiseAND(F.lit((1 << _SHIFT) - 1)).cast("int"), lambda p: F.concat(F.slice(ids, F.lit(1), p), F.array(F.shiftright(best, _SHIFT).cast("int")), F.slice(ids, p + 3, F.lit(1 << 30))))
        return _let(F.array_min(ranked), lambda best: F.when(best.isNull(), ids).otherwise(joined(best)))

    def encode(self, word: Column) -> Column:
        """array<int> ids of a word (binary, LONG bytes at most)."""
        units = F.transform(F.regexp_extract_all(F.hex(word), F.lit(".."), F.lit(0)), lambda h: F.get(self.bytes, F.conv(h, 16, 10).cast("int")))
        return _let(units, lambda u: F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(u), F.lit(2))), u, self._merge))


def merge_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of a word of any length: a heap of pairs by rank, then place, over a linked list of parts."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that begins here
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue  # one of its parts has grown or gone since
        end[i], after[i], alive[j] = stop, after[j], False
        if after[j] < n:
            before[after[j]] = i
        for a in (i, before[i]):
            if a >= 0 and after[a] < n and (r := rank.get(word[a : end[after[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[after[a]]))
    return [rank[word[i : end[i]]] for i in range(n) if alive[i]]


def decode(ids: np.ndarray, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bytes of ids: pieces of one byte array (tokens, with each id's start and size), concatenated."""
    n = sizes[ids]
    total = int(n.sum())
    if not total:
        return b""
    begin = np.cumsum(n) - n
    return tokens[np.repeat(starts[ids] - begin, n) + np.arange(total)].tobytes()


def word_counts(df: DataFrame, pattern: str) -> DataFrame:
    """(word binary, n) over all texts; each task sums before the shuffle."""

    def run(batches):
        import regex

        cut = regex.compile(pattern)
        for b in batches:
            seen: Counter = Counter()
            for part in small([b], 1024):
                seen.update(chain.from_iterable(cut.findall(t) for t in part.column(0).to_pylist() if t))
            yield pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogatepass") for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return df.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode(df: DataFrame, rank_file: str, pattern: str, cache: int = CACHE) -> DataFrame:
    """doc_id, ids binary (little-endian unsigned 32-bit) of every whole text, in batches of texts.

    Tasks cut texts and look up what the cache holds; of what it does not hold, a batch's distinct words go through
    the fold, and a second task function puts the ids together.
    """
    pattern = public_pattern(pattern)
    merges = Merges(load_ranks(rank_file))
    common = word_counts(df, pattern).where(f"n > 1 AND length(word) <= {LONG}").orderBy(F.desc("n"), "word").limit(cache)
    folded = common.repartition(partitions(df)).select("word", merges.encode(F.col("word")).alias("ids")).toArrow()
    known: dict[str, bytes] = {}
    for b in folded.to_batches(max_chunksize=4096):
        at, data = b.column(1).offsets.to_numpy() - b.column(1).offsets[0].as_py(), b.column(1).flatten().to_numpy().astype("<u4").tobytes()
        known.update((w.decode("utf-8", "surrogatepass"), data[4 * i : 4 * j]) for w, i, j in zip(b.column(0).to_pylist(), at[:-1], at[1:], strict=True))
    shared = df.sparkSession.sparkContext.broadcast(known)
    del folded, known

    def cut_texts(batches):
        """A row per document: its ids, where a word to be folded stands as its number with the high bit set; the words on
        the first row of their batch part."""
        import regex

        cut = regex.compile(pattern)
        get = shared.value.get
        rank: dict[bytes, int] = {}
        for part in small(batches, 1024):
            doc_ids, all_texts, at = part.column(0).to_pylist(), part.column(1).to_pylist(), 0
            while at < len(all_texts):
                end, size = at, 0
                while end < len(all_texts) and size < BATCH:
                    size += len(all_texts[end] or "")
                    end += 1
                new: dict[str, bytes] = {}
                out = []
                for t in all_texts[at:end]:
                    words = cut.findall(t) if t else []
                    ids = list(map(get, words))
                    if None in ids:
                        for i, x in enumerate(ids):
                            if x is None:
                                w = words[i]
                                if len(w) > LONG // 4 and len(data := w.encode("utf-8", "surrogatepass")) > LONG:
                                    if not rank:
                                        rank.update((t, k) for k, t in enumerate(load_ranks(rank_file)))
                                    ids[i] = np.array(merge_long(data, rank), "<u4").tobytes()
                                    continue
                                if w not in new:
                                    new[w] = (len(new) | 1 << 31).to_bytes(4, "little")
                                ids[i] = new[w]
                    out.append(b"".join(ids))
                words = [[w.encode("utf-8", "surrogatepass") for w in new]] + [[]] * (end - at - 1)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[at:end], pa.int64()), pa.array(out, pa.binary()), pa.array([i == 0 for i in range(end - at)]), pa.array(words, pa.list_(pa.binary()))], ["doc_id", "ids", "first", "words"])
                at = end

    def put_together(batches):
        folds, starts, sizes = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        for b in small(batches):
            out = []
            for data, first, words in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if first:
                    sizes = np.array([len(x) for x in words.values], np.int64) if len(words.values) else np.zeros(1, np.int64)
                    folds = words.values.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(words.values) else np.zeros(0, np.int64)
                    starts = np.cumsum(sizes) - sizes
                ids = np.frombuffer(data, "<u4").astype(np.int64)
                marked = ids >= 1 << 31
                if marked.any():
                    w = np.where(marked, ids & 0x7FFFFFFF, 0)
                    n = np.where(marked, sizes[w], 1)
                    begin = np.cumsum(n) - n
                    wide = np.repeat(ids, n)
                    inner = np.arange(len(wide)) - np.repeat(begin, n)
                    which = np.repeat(marked, n)
                    wide[which] = folds[np.repeat(starts[w], n)[which] + inner[which]]
                    ids = wide
                out.append(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])

    cut = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_texts, "doc_id long, ids binary, first boolean, words array<binary>")
    folded = cut.select("doc_id", "ids", "first", F.transform("words", merges.encode).alias("words"))
    return folded.mapInArrow(put_together, "doc_id long, ids binary")


def decoded(df: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, ids, bytes binary: what the ids stand for."""

    def run(batches):
        tokens = load_ranks(rank_file)
        sizes = np.array([len(t) for t in tokens], np.int64)
        data, starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes
        for b in small(batches):
            out = [decode(np.frombuffer(x, "<u4").astype(np.int64), data, starts, sizes) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document, decodes the ids, and digests both."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    out = decoded(ids, path)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
