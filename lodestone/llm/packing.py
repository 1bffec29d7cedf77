"""Best-fit packing of token pieces into sequences of fixed capacity, by bin completion.

Texts are tokenised in Arrow tasks; only lengths matter for packing, and there are at most `capacity` of them. The plan
is therefore made on the histogram of lengths (bounded, whatever the input): the largest remaining length is completed
by an undominated filling of the room beside it, found by branch and bound on waste with the best-fit filling as the
incumbent; a filling is applied as often as its lengths allow. Pieces then find their place by their rank among pieces
of their length, which is counted per partition and offset by the partitions before.

Defined cases: null and empty texts are one piece holding id 0 only. Repeated rows are packed as rows. Extra columns are ignored.
"""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import read, small, written

CAPACITY = 2048
END_ID = 0
CACHE = 300_000  #: distinct words whose ids a Python worker remembers
CHUNK = 64  #: longer words are not remembered
BRANCHES, NODES, RETRIES = 4, 2_000, 400
Filling = tuple[tuple[int, int], ...]  # (length, times), lengths falling


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, by the tokenizer's own model.

    Where a text has only Latin characters (below U+0250), on which the tokenizer's normaliser does nothing but
    lower-case, it is cut into words here and each word goes through the model once; the ids are remembered. Of other texts the
    chunks between spaces that hold further characters go through the whole tokenizer.
    """

    _letter = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
    _number = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
    _cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_letter}]+|[{_number}]|[^\t-\r \x85\xa0{_letter}{_number}]+")
    _odd = re.compile("[^\x00-\u024f]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the tokenizer takes its added tokens out of a text before anything else
        self.special = {t.content: int(i).to_bytes(4, "little") for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self._special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.alphabet = {b: b if b in shown else next(hidden) for b in range(256)}
        self.known: dict[str, bytes] = {}

    def _new(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))
        ids = np.array([t.id for t in tokens], "<u4").tobytes()
        if len(word) <= CHUNK:
            self.known[word] = ids
        return ids

    def _latin(self, text: str) -> bytes:
        words = self._cut.findall(text.lower())
        ids = list(map(self.known.get, words))
        if None in ids:
            ids = [x if x is not None else self._new(w) for x, w in zip(ids, words, strict=True)]
        return b"".join(ids)

    def __call__(self, text: str) -> bytes:
        if len(self.known) > CACHE:
            self.known.clear()
        if self._special and self._special.search(text):
            return b"".join(self.special.get(x) or self._plain(x) for x in self._special.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not self._odd.search(text):
            return self._latin(text)
        return b"".join(np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() if self._odd.search(c) else self._latin(c) for c in text.split(" "))


_encoders: dict[str, Encoder] = {}
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """A row per piece; part and nth: its partition and its number among pieces of its length there; ids: with them."""

    def run(batches):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encode = _encoders[tokenizer]
        part, seen = TaskContext.get().partitionId(), Counter()
        names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * ids
        for b in small(batches):
            out = []
            doc_ids, all_texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for doc_id, text in zip(doc_ids, all_texts, strict=True):
                data = encode(text) + END_ID.to_bytes(4, "little")
                for i, start in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[start : start + 4 * capacity]
                    n = len(piece) // 4
                    out.append((doc_id, i, start // 4, n, zlib.crc32(piece), part, seen[n], *[piece] * ids))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=False)], names)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE + ", ids binary" * ids)


def _fits_into(b: list[int], a: list[int]) -> bool:
    """Whether the items b can be packed into bins of the sizes a."""
    if not b:
        return True
    for i in range(len(a)):
        if a[i] >= b[0] and (i == 0 or a[i] != a[i - 1]) and _fits_into(b[1:], sorted([*a[:i], a[i] - b[0], *a[i + 1 :]], reverse=True)):
            return True
    return False


def _items(f: Filling) -> list[int]:
    return [x for x, n in f for _ in range(n)]


def completions(counts: dict[int, int], room: int, branches: int = BRANCHES) -> list[Filling]:
    """The best undominated fillings of the room, least waste first; the best-fit filling is the first incumbent."""
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    if not lengths:
        return [()]
    if lengths[0] == room:
        return [((room, 1),)]  # dominates every other filling
    least = lengths[-1]
    greedy, left = [], room
    for x in lengths:
        n = min(counts[x], left // x)
        if n:
            greedy.append((x, n))
            left -= n * x
    found: dict[Filling, int] = {tuple(greedy): left}
    nodes = 0
    stack: list[tuple[int, int, Filling]] = [(0, room, ())]
    while stack and nodes < NODES and sum(w == 0 for w in found.values()) < branches:
        at, left, filling = stack.pop()
        nodes += 1
        if left < least:
            worst = sorted(found.values())[: branches]
            if len(found) < branches or left < worst[-1]:
                found[filling] = left
            continue
        more = [i for i in range(at, len(lengths)) if lengths[i] <= left]
        if not more:
            found.setdefault(filling, left)
            continue
        for i in reversed(more[:24]):
            x = lengths[i]
            for n in {1, min(counts[x], left // x)}:
                stack.append((i + 1, left - n * x, (*filling, (x, n))))
    best = sorted(found, key=lambda f: (found[f], sum(n for _, n in f)))[: 2 * branches]
    kept: list[Filling] = []
    for f in best:
        small = _items(f)
        if len(small) > 6 or not any(len(_items(g)) <= 6 and _fits_into(small, _items(g)) for g in kept):
            kept.append(f)
    return kept[:branches]


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: by volume, and by pieces too long to share with what is over `capacity - k`."""
    total = sum(x * n for x, n in hist.items())
    best = -(-total // capacity)
    for k in {0, *(x for x in hist if x <= capacity // 2)}:
        alone = sum(n for x, n in hist.items() if x > capacity - k)
        half = {x: n for x, n in hist.items() if capacity - k >= x > capacity // 2}
        rest = sum(x * n for x, n in hist.items() if capacity // 2 >= x >= k)
        free = sum((capacity - x) * n for x, n in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-(rest - free) // capacity)))
    return best


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Filling]]:
    """(times, filling of a sequence), by bin completion; branches back while a bound leaves something to gain."""
    bound = lower_bound(hist, capacity)
    total = sum(x * n for x, n in hist.items())
    counts = dict(hist)
    best: list[tuple[int, Filling]] | None = None
    best_bins, waste, bins, retries = 0, 0, 0, 0
    path: list[tuple[int, Filling, int]] = []  # applied: times, filling, waste
    options: list[list[Filling]] = []

    def expand() -> list[Filling]:
        largest = max((x for x, n in counts.items() if n), default=0)
        if not largest:
            return []
        counts[largest] -= 1
        fillings = completions(counts, capacity - largest)
        counts[largest] += 1
        merged = []
        for f in fillings:
            c = Counter({largest: 1})
            c.update(dict(f))
            merged.append(tuple(sorted(c.items(), reverse=True)))
        return merged[::-1]

    options.append(expand())
    while options:
        if options[-1]:
            f = options[-1].pop()
            times = min(counts[x] // n for x, n in f)
            w = times * (capacity - sum(x * n for x, n in f))
            if best is not None and waste + w > (best_bins - 1) * capacity - total:
                continue  # cannot save a sequence any more
            for x, n in f:
                counts[x] -= n * times
            path.append((times, f, w))
            waste, bins = waste + w, bins + times
            if any(counts.values()):
                options.append(expand())
                continue
            if best is None or bins < best_bins:
                best, best_bins = [(t, f) for t, f, _ in path], bins
        elif len(options) == 1:
            break
        else:
            options.pop()
        # step back by one
        if best is not None:
            retries += 1
            if best_bins <= bound or retries > RETRIES:
                break
        times, f, w = path.pop()
        for x, n in f:
            counts[x] += n * times
        waste, bins = waste - w, bins - times
    return best or []


def places(patterns: list[tuple[int, Filling]]) -> np.ndarray:
    """Rows (length, first rank, times per sequence, first sequence, offset), by length and rank."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for times, filling in patterns:
        offset = 0
        for x, n in filling:
            rows.append((x, used[x], n, sequence, offset))
            used[x] += n * times
            offset += x * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the ids, little-endian, if asked for)."""
    rows = written(pieces(df, tokenizer, capacity, ids), "pieces")
    per_part = written(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    hist = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(hist, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def run(batches):
        keys = table[:, 0] * (1 << 44) + table[:, 1]  # rank within length: at most 2**44 pieces of a length
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1] if b.num_rows else table[:0]
            past = rank - row[:, 1]
            cols = [b.column(b.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 3] + past // np.maximum(row[:, 2], 1)), pa.array(row[:, 4] + past % np.maximum(row[:, 2], 1) * length)], [*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * ids + "sequence_id long, offset long")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the pieces of all documents into sequences of 2048 tokens."""
    return pack(read(spark, sf_dir, "documents"), word_tokenizer())
