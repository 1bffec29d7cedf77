"""Substring dedup: words that stand in a window of WINDOW words which also starts earlier go.

Each window has an anchor, the ANCHOR words in it with the smallest hash, so equal windows have equal anchors. Consecutive windows
with one anchor are a segment. Equal segments are reduced, before and after the shuffle, to their first place; a window that
stands in no other kind of segment of its anchor has its first place there too. Where an anchor has several
kinds of segments, their words go to the anchor's shard. A shard is a packed FM-index (wavelet matrix of the Burrows-Wheeler
transform, bit vectors with rank directories) of some SHARD words, through which its segments stream: backward search gives each place's
matching statistic, capped at WINDOW, and the interval of suffixes that begin with the window, whose earliest place
is stored with the index. An anchor with over HOT kinds is dealt out window by window, equal ones reduced first.

What comes back to a document are its segments and windows that stand there first; all other windows start earlier somewhere. Each row
has one document, so no copy count decides the size of a group. Hashes of 128 bits (anchor and segment) decide that two segments
are one; words decide in the index. Anchors are found again from the text instead of being stored.

Defined cases: null and empty texts have no words and stay as they are (null is returned as empty); texts under WINDOW words keep all. Rows that repeat
a doc_id are one place each: of their windows at the same start none is the earlier. Without a doc_id a document
stays whole and makes no other window go. Extra columns are ignored; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_broadcast, discard, partitions, read, small, texts, written
from lodestone.llm.hashing import grams, mix, stretches, word_hashes

WINDOW, ANCHOR = 20, 5
HOT = 4096  #: kinds of segments beyond which an anchor's windows are dealt out singly
ANCHORS = 4_000_000  #: at most so many anchors with several kinds (9 bytes each) are broadcast; beyond, the joins shuffle
SHARD = 1_000_000  #: words of an index, beyond which it ends with the next key


class FMIndex:
    """Backward search over a sequence of symbols (0 separates), for patterns of `depth` symbols, with the least mark of each.

    Suffixes are sorted by twice the largest power of two within depth, which is all that patterns of depth + 1 symbols need.
    """

    def __init__(self, text: np.ndarray, marks: np.ndarray, depth: int):
        n = len(text)
        rank, h = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while h <= depth:
            half = rank
            ahead = np.zeros(n, np.int64)
            if h < n:
                ahead[: n - h] = half[h:] + 1
            rank = np.unique(half * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
            h *= 2
        order = np.argsort(rank, kind="stable")
        # half is the rank of the first h/2 symbols; two of them that overlap tell the first `depth` symbols apart
        shift = np.minimum(order + depth - h // 2, n - 1)
        one, two = half[order], half[shift]
        self.groups = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
        self.least = np.minimum.reduceat(marks[order], self.groups)
        self.n, self.depth = n, depth
        bwt = text[order - 1].astype(np.int64)
        self.bits = max(1, int(text.max()).bit_length())
        self.levels = []
        symbols = np.arange(1 << self.bits)
        at = np.zeros(1 << self.bits, np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = ((bwt >> level) & 1).astype(np.uint8)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            packed = packed.view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1])).astype(np.int32)
            self.levels.append((level, packed, before, n - int(bit.sum())))
            at = self._down(self.levels[-1], symbols, at)
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
        smaller = np.searchsorted(np.sort(text), symbols)
        self.base = smaller - at

    @staticmethod
    def _down(level, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        shift, packed, before, zeros = level
        ones = before[i >> 6] + np.bitwise_count(packed[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
        return np.where((symbol >> shift) & 1, zeros + ones, i - ones)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the suffixes that begin with the symbol and then what [low, high) begins with."""
        known = symbol < len(self.base)
        high = np.where(known, high, low)  # an unknown symbol begins no suffix
        symbol = np.where(known, symbol, 0)
        both, i = np.concatenate((symbol, symbol)), np.concatenate((low, high))
        for level in self.levels:
            i = self._down(level, both, i)
        i = i + self.base[both]
        return i[: len(low)], i[len(low) :]

    def stream(self, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For every place of the streamed sequences text[start : start + length], the least mark of the `depth` symbols from there; -1
        where they do not stand in the index. Sequences go right to left, all at once."""
        out = np.full(len(text), -1, np.int64)
        low, high, have = np.zeros(len(start), np.int64), np.full(len(start), self.n), np.zeros(len(start), np.int64)
        for t in range(int(length.max(initial=0))):
            on = np.flatnonzero(t < length)
            at = start[on] + length[on] - 1 - t
            symbol = text[at]
            a, b = self.extend(symbol, low[on], high[on])
            depth = have[on] + 1
            for k in np.flatnonzero(a >= b):  # this place ends the match: search its window anew, as long as it has matches
                a[k], b[k], depth[k] = self._again(text, at[k], start[on[k]] + length[on[k]])
            full = np.flatnonzero(depth >= self.depth)
            group = np.searchsorted(self.groups, a[full], "right") - 1
            out[at[full]] = self.least[group]
            a[full] = self.groups[group]  # the last symbol leaves: all suffixes with the same first `depth` symbols
            b[full] = np.append(self.groups, self.n)[group + 1]
            low[on], high[on], have[on] = a, b, np.minimum(depth, self.depth)
        return out

    def _again(self, text: np.ndarray, at: int, end: int) -> tuple[int, int, int]:
        """The longest match from this place on, up to `depth` symbols, and its interval."""
        for stop in range(min(end, at + self.depth), at, -1):
            low, high = np.array([0]), np.array([self.n])
            for i in range(stop - 1, at - 1, -1):
                low, high = self.extend(text[i : i + 1], low, high)
                if low[0] >= high[0]:
                    break
            else:
                return int(low[0]), int(high[0]), stop - at
        return 0, self.n, 0


def segments(w: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """anchor, hash, and place of each segment of a document's word hashes. A place is one number: the first word, the number of
    windows (5 bits) and 27 bits of the hash, so that places sort by first word and tell rows of one doc_id apart."""
    m = len(w) - window + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3
    g = grams(w, ANCHOR)
    key = ((mix(g) >> np.uint64(33)) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    size, places = 1, window - ANCHOR + 1
    while 2 * size <= places:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < places:
        key = np.minimum(key[: len(key) - (places - size)], key[places - size :])
    chosen = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    end = np.append(start[1:], m)
    h = stretches(w, start, end + window - 1)
    place = (start << 32) | ((end - start) << 27) | (h & np.uint64((1 << 27) - 1)).astype(np.int64)
    return g[chosen[start]].view(np.int64), h.view(np.int64), place


def _of_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of windows."""
    return place >> 32, (place >> 27) & 31


def _kinds(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, h, first struct<doc, place>): each distinct segment with its first place."""

    def run(batches):
        for b in small(batches):
            cols = [[], [], [], []]
            for doc, text in zip(b.column(0).to_numpy(zero_copy_only=False), texts(b), strict=True):
                anchor, h, place = segments(word_hashes(text, False), window)
                for c, x in zip(cols, (anchor, h, np.full(len(h), doc), place), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in cols], ["anchor", "h", "doc", "place"])

    rows = docs.mapInArrow(run, "anchor long, h long, doc long, place long")
    return rows.groupBy("anchor", "h").agg(F.min(F.struct("doc", "place")).alias("first"))


_PIECES = "key long, words binary, doc long, place long, skip long, n long, hot boolean"


def _pieces(asked: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The words of the asked segments, (doc, wanted array<struct<anchor, place, hot>>), or of each of their windows if hot."""

    def run(batches):
        for b in small(batches, 128):
            rows = []
            for doc, text, wanted in zip(b.column(0).to_pylist(), texts(b), b.column(2).to_pylist(), strict=True):
                words, w = text.split(), word_hashes(text, False)
                anchor, _, place = segments(w, window)
                have = set(zip(anchor.tolist(), place.tolist(), strict=True))
                for x in wanted:
                    a, p, hot = x["anchor"], x["place"], x["hot"]
                    if (a, p) not in have:  # of another row with this doc_id
                        continue
                    s, n = p >> 32, (p >> 27) & 31
                    if hot:
                        keys = stretches(w, np.arange(s, s + n), np.arange(s, s + n) + window).view(np.int64).tolist()
                        rows += [(k, b" ".join(words[s + i : s + i + window]), doc, p, i, 1, True) for i, k in enumerate(keys)]
                    else:
                        rows.append((a, b" ".join(words[s : s + n + window - 1]), doc, p, 0, n, False))
            kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds, strict=True)], [c.split()[0] for c in _PIECES.split(", ")])

    return docs.join(asked, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "wanted").mapInArrow(run, _PIECES)


def _firsts_of_shard(words: list[bytes], doc: np.ndarray, place: np.ndarray, skip: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Bit masks of the windows of each piece that start nowhere earlier in this shard."""
    known: dict[bytes, int] = {}
    split = [x.split() for x in words]
    length = np.array([len(x) for x in split])
    start = np.cumsum(length + 1) - length - 1
    text = np.zeros(int(length.sum()) + len(split) + 1, np.int64)
    for s, x in zip(start.tolist(), split, strict=True):
        text[s : s + len(x)] = [known.setdefault(y, len(known) + 1) for y in x]
    piece = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at, who, begin = start[piece] + nth, doc[piece], (place[piece] >> 32) + skip[piece] + nth
    order = np.lexsort((begin, who))
    step = np.concatenate(([False], (who[order][1:] != who[order][:-1]) | (begin[order][1:] != begin[order][:-1])))
    mark = np.empty(len(order), np.int64)
    mark[order] = np.cumsum(step)
    marks = np.full(len(text), np.iinfo(np.int64).max)
    marks[at] = mark
    least = FMIndex(text, marks, window).stream(text, start, length)
    masks = np.zeros(len(n), np.int64)
    np.bitwise_or.at(masks, piece, np.where(least[at] == mark, np.int64(1) << (skip[piece] + nth), 0))
    return masks


def _search(pieces: DataFrame, window: int) -> DataFrame:
    """(doc, place, mask): the windows of the pieces that stand there first. Pieces of one key are together, whole keys fill an index."""

    def index(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables).combine_chunks()
        doc, place, skip, n = (t.column(c).to_numpy() for c in ("doc", "place", "skip", "n"))
        masks = _firsts_of_shard(t.column("words").to_pylist(), doc, place, skip, n, window)
        kept = np.flatnonzero(masks)
        return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (doc, place, masks)], ["doc", "place", "mask"])

    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.concatenate(([keys[0] != last], keys[1:] != keys[:-1]))), b.num_rows)
            if cuts[0]:
                held.append(b.slice(0, cuts[0]))
                size += _words(held[-1])
            at = cuts[0]
            while at < b.num_rows:  # whole keys, as many as fit
                if size >= SHARD:
                    yield index(held)
                    held, size = [], 0
                upto = np.cumsum(b.column(5).to_numpy()[at:] + window - 1)
                fit = cuts[cuts > at]
                end = fit[min(np.searchsorted(upto[fit - at - 1], SHARD - size), len(fit) - 1)]
                held.append(b.slice(at, end - at))
                size += _words(held[-1])
                at = end
            last = keys[-1]
        if held:
            yield index(held)

    def _words(b: pa.RecordBatch) -> int:
        return int(b.column(5).to_numpy().sum()) + (window - 1) * b.num_rows

    return pieces.mapInArrow(run, "doc long, place long, mask long")


def first_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, place, mask): of each document's segments, which windows start nowhere earlier. docs: (doc_id, text) with a doc_id."""
    n = partitions(docs)
    kinds = written(_kinds(docs, window).select("anchor", "first.doc", "first.place"), "segments", drop_shuffles=True)
    several = kinds.groupBy("anchor").count().where("count > 1").select("anchor", (F.col("count") > HOT).alias("hot"))
    several = written(several, "anchors", drop_shuffles=True)
    several = bounded_broadcast(several, several.count(), ANCHORS)
    alone = kinds.join(several, "anchor", "left_anti").select("doc", "place", F.expr("shiftleft(1L, int(shiftright(place, 27) & 31)) - 1").alias("mask"))
    asked = kinds.join(several, "anchor").groupBy("doc").agg(F.collect_list(F.struct("anchor", "place", "hot")).alias("wanted"))
    pieces = written(_pieces(asked, docs, window), "pieces", drop_shuffles=True)
    hot = pieces.where("hot").groupBy("key", "words").agg(F.min(F.struct("doc", (F.shiftright("place", 32) + F.col("skip")).alias("begin"), "place", "skip")).alias("f"))
    hot = hot.select("key", "words", "f.doc", "f.place", "f.skip", F.lit(1).cast("long").alias("n"))
    every = pieces.where("NOT hot").drop("hot").unionByName(hot)
    found = written(_search(every.repartition(n, "key").sortWithinPartitions("key"), window), "firsts", drop_shuffles=True)
    discard(pieces)
    return alone.unionByName(found)


def dedup_substrings(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words that stay, joined by one space."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id IS NOT NULL")
    firsts = first_windows(known, window).groupBy("doc").agg(F.collect_list(F.struct("place", "mask")).alias("firsts"))
    rows = known.join(firsts, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "firsts").unionByName(docs.where("doc_id IS NULL").withColumn("firsts", F.lit(None).cast("array<struct<place:long,mask:long>>")))

    def run(batches):
        for b in small(batches):
            out = []
            for i, text, (place, mask) in zip(b.column(0), texts(b), _lists(b.column(2)), strict=True):
                words = text.split()
                w = word_hashes(text, False) if i.is_valid else np.zeros(0, np.uint64)
                gone = np.flatnonzero(_removed(w, place, mask, window))
                kept = np.delete(np.arange(len(words)), gone) if len(gone) else None
                out.append((len(words), len(gone), b" ".join(words if kept is None else [words[k] for k in kept])))
            n, removed, kept = zip(*out, strict=True) if out else ([],) * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def _lists(column: pa.Array):
    """place and mask of each row's list."""
    flat = column.flatten()
    place, mask = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    at = 0
    for n in column.value_lengths().fill_null(0).to_pylist():
        yield place[at : at + n], mask[at : at + n]
        at += n


def _removed(w: np.ndarray, place: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """For each word, whether a window covers it that is none of the first ones."""
    m = len(w) - window + 1
    if m <= 0:
        return np.zeros(len(w), bool)
    own = segments(w, window)[2]
    at = np.searchsorted(own, place)
    at = np.minimum(at, len(own) - 1)
    bits = np.zeros(len(own), np.int64)
    ok = own[at] == place
    np.bitwise_or.at(bits, at[ok], mask[ok])
    start, n = _of_place(own)
    nth = np.arange(m) - np.repeat(start, n)
    repeated = (np.repeat(bits, n) >> nth) & 1 == 0
    step = np.zeros(len(w) + 1, np.int64)
    step[:m] += repeated
    step[window : window + m] -= repeated
    return np.cumsum(step[:-1]) > 0


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents outside windows of twenty words that start earlier somewhere."""
    out = dedup_substrings(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
