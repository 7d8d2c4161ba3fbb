"""Substring dedup: repeated windows of 20 words, by FM-indexes over wavelet matrices.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged (null: none).  A word goes if it lies
in a window whose words also start earlier: in a document with a smaller id, or
earlier in the same one.  Windows are judged on the input.

1. Every window gets the smallest 8-word hash within it as its anchor (the
   first of equals), so equal windows have equal anchors.  Anchors are counted
   (combined before the shuffle); those seen twice set bits in a sieve of fixed
   size (2**SIEVE_BITS bits), the only thing broadcast.
2. A second scan writes the runs of windows of the sieved anchors as segments
   (anchor, words from the first to the last window).  Wrong sieve hits cost
   volume only.  Equal segments are combined before their shuffle, keeping the
   earliest; so groups of copies become one row.  Anchors with more than CAP
   different segments (a passage in changing surroundings) have theirs cut into
   single windows, which are combined again and dealt by the window.
3. The segments of a partition, sorted by anchor, go into FM-indexes of bounded
   size, all of an anchor's in one: the Burrows-Wheeler transform in a wavelet
   matrix of packed bits with sampled ranks.  Segments are streamed through it
   from their end by backward search, all side by side; a match that reaches
   the window's length is cut back to it, and the earliest text position of the
   interval says whether the window starts earlier elsewhere.
4. Verdicts return to the segments' places, and the words to remove to their
   documents.  Only documents that a sieve of affected ids names are shuffled;
   the others are finished where they are read.

Words are compared by 64-bit hashes of their bytes.  Rows that share an id are
judged at their own places and never remove each other at equal places.  Rows
with a null id are kept as they are.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_minima, gram_hashes, in_sieve, map_arrow, materialise, run_hashes, sieve, slices, utf8, word_hashes, words

WINDOW, K = 20, 8
SIEVE_BITS, ID_BITS = 27, 24
CAP = 4096
INDEX_WORDS = 400_000

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


class Text:
    """Words of a batch, joined by single spaces where a text had any gap."""

    def __init__(self, texts: pa.Array):
        buf, off = utf8(texts)
        s, e, of = words(buf, off, _IS_WORD)
        self.n = len(texts)
        self.at = np.searchsorted(of, np.arange(self.n + 1))
        keep = _IS_WORD[buf]
        gap = s[1:][s[1:] > e[:-1]] - 1
        keep[gap] = True
        new = np.cumsum(keep) - 1
        out = buf[keep]
        if len(gap):
            out[new[gap]] = 32
        self.buf = out
        self.s = new[s] if len(s) else s
        self.e = new[e - 1] + 1 if len(e) else e
        self.ids = word_hashes(out, self.s, self.e)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of consecutive windows of one text with one anchor: anchor hash, first window, number of windows, text."""
        n = len(self.ids) - WINDOW + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none.astype(np.uint64), none, none, none
        g = gram_hashes(self.ids, K)
        place = first_minima(g, WINDOW - K + 1)
        last = np.repeat(self.at[1:], np.diff(self.at))[:n]
        whole = np.flatnonzero(np.arange(n) + WINDOW <= last)
        if not len(whole):
            return none.astype(np.uint64), none, none, none
        p = place[whole]
        new = np.concatenate(([True], (p[1:] != p[:-1]) | (whole[1:] != whole[:-1] + 1)))
        at = np.flatnonzero(new)
        first = whole[at]
        return g[p[at]], first, np.diff(np.append(at, len(whole))), np.searchsorted(self.at, first, side="right") - 1


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., for each start as many as its size."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _binary(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    size = e - s
    off = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(buf[_ragged(s, size)]))])


def _hash_runs(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of words."""
    return run_hashes(ids, start, size, 0).view(np.int64), run_hashes(ids, start, size, 1).view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        h, _, _, _ = Text(part.column("text")).runs()
        h, n = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["anchor", "n"])


SEGMENT = "anchor bigint, h1 bigint, h2 bigint, id bigint, pos bigint, n int, seg binary"


class Bits:
    """Packed bits with sampled ranks: a block holds 32 bits, and above them how many are set before it."""

    def __init__(self, bit: np.ndarray):
        n = len(bit)
        padded = np.zeros((n // 32 + 1) * 32, np.uint8)
        padded[:n] = bit
        packed = np.packbits(padded, bitorder="little").view(np.uint32).astype(np.uint64)
        before = np.cumsum(np.bitwise_count(packed), dtype=np.uint64)
        before[1:], before[0] = before[:-1].copy(), 0
        self.blocks = before << np.uint64(32) | packed

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        x = self.blocks[i >> 5]
        below = (np.uint64(1) << (i & 31).view(np.uint64)) - np.uint64(1)
        return ((x >> np.uint64(32)) + np.bitwise_count(x & below)).view(np.int64)


class WaveletMatrix:
    """Ranks over a sequence of small numbers."""

    def __init__(self, x: np.ndarray, top: int):
        self.levels = []
        self.bits = max(1, int(top).bit_length())
        x = x.astype(np.int32)
        for k in range(self.bits - 1, -1, -1):
            bit = (x >> k & 1).astype(bool)
            zeros = x[~bit]
            self.levels.append((k, Bits(bit), len(zeros)))
            x = np.concatenate((zeros, x[bit]))
        # where the runs of each number begin after the last level
        self.begin = np.searchsorted(self._reverse(x), self._reverse(np.arange(top + 1, dtype=np.int32)))

    def _reverse(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        for k in range(self.bits):
            out |= (x >> k & 1) << (self.bits - 1 - k)
        return out

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i numbers are c."""
        start = self.begin[c]
        for k, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(c >> k & 1, zeros + ones, i - ones)
        return i - start


class FMIndex:
    """Compressed index of joined segments (0 ends each), for patterns up to WINDOW words.

    It keeps the Burrows-Wheeler transform in a wavelet matrix, where each word
    begins, one bit a suffix where the first WINDOW words change, and the least
    place of each run between such bits; not the suffixes' positions.
    """

    def __init__(self, text: np.ndarray, sigma: int, place: np.ndarray):
        n = len(text)
        bits = max(n.bit_length(), 1)
        rank, width, kept = text.astype(np.int64), 1, {}
        while width <= WINDOW:
            nxt = np.zeros(n, np.int64)
            nxt[:-width] = rank[width:] + 1
            if 3 * bits <= 63:
                key = np.sort(rank << 2 * bits | nxt << bits | np.arange(n))
                order, group = key & ((1 << bits) - 1), key >> bits
            else:
                order = np.lexsort((nxt, rank))
                group = rank[order] * (n + 2) + nxt[order]
            head = np.concatenate(([True], group[1:] != group[:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(head) - 1
            width *= 2
            kept[width] = rank
            if head.all():
                break
        self.n = n
        self.matrix = WaveletMatrix(text[order - 1], sigma)
        self.first = np.searchsorted(text[order], np.arange(sigma + 2))
        # a suffix begins like the one before it if their first words agree, and those after them up to WINDOW
        differs, done = np.zeros(n - 1, bool), 0
        for size in sorted(kept, reverse=True):
            while done + size <= WINDOW:
                at = np.minimum(order + done, n - 1)
                differs |= kept[size][at[1:]] != kept[size][at[:-1]]
                done += size
        cut = np.concatenate(([True], differs))
        self.starts = np.append(np.flatnonzero(cut), n)
        self.cuts = Bits(cut)
        self.least = np.minimum.reduceat(place[order], self.starts[:-1])

    def step(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c + pattern."""
        both = self.matrix.rank(np.concatenate((c, c)), np.concatenate((lo, hi)))
        base = self.first[c]
        return base + both[: len(c)], base + both[len(c) :]

    def run(self, lo: np.ndarray) -> np.ndarray:
        """Number of the run of suffixes with the same first WINDOW words that lo lies in."""
        return self.cuts.rank(lo + 1) - 1


def judge(word: np.ndarray, size: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each segment (its words one after the other in `word`) a mask of the windows that start earlier elsewhere.

    doc, pos: the segment's earliest place.
    """
    code, _ = pd.factorize(word)
    n = size + 1
    begin = np.cumsum(n) - n
    total = int(n.sum())
    offset = np.arange(total) - np.repeat(begin, n)
    text = np.zeros(total, np.int64)
    text[offset < np.repeat(size, n)] = code + 1
    _, by_doc = np.unique(doc, return_inverse=True)
    place = np.repeat(by_doc << 40 | pos, n) + offset
    index = FMIndex(text, int(code.max()) + 1, place)
    mask = np.zeros(len(size), np.int64)
    live = np.argsort(-size, kind="stable")
    at = begin[live] + size[live] - 1
    lo, hi, length = np.zeros(len(live), np.int64), np.full(len(live), total), np.zeros(len(live), np.int64)
    while len(live):
        lo, hi = index.step(lo, hi, text[at])
        length += 1
        some = np.flatnonzero(length >= WINDOW)
        if len(some):
            # a match longer than a window goes back to the interval of its first WINDOW words
            run = index.run(lo[some])
            lo[some], hi[some], length[some] = index.starts[run], index.starts[run + 1], WINDOW
            earlier = index.least[run] < place[at[some]]
            some = some[earlier]
            mask[live[some]] |= 1 << offset[at[some]]
        go = offset[at] > 0
        live, at, lo, hi, length = live[go], at[go] - 1, lo[go], hi[go], length[go]
    return mask


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct segments sorted by key -> verdicts (anchor, h1, h2, id, pos, mask) of those with any, or seen more than once."""

    def work(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables).combine_chunks()
        buf, off = _bytes(t["seg"])
        s, e, of = words(buf, off, _IS_WORD)
        size = np.bincount(of, minlength=len(t))
        doc, pos = t["id"].to_numpy(), t["pos"].to_numpy()
        mask = judge(word_hashes(buf, s, e), size, doc, pos)
        keep = np.flatnonzero((mask != 0) | (t["times"].to_numpy() > 1))
        out = t.select(["anchor", "h1", "h2", "id", "pos"]).take(pa.array(keep)).append_column("mask", pa.array(mask[keep]))
        return out.combine_chunks().to_batches()[0] if len(keep) else pa.RecordBatch.from_pylist([], schema=out.schema)

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(batch.schema.get_field_index("key")).to_numpy()
        # cut before the last key that begins in the batch: an index holds whole keys
        if held and key[0] != held[-1].column("key").to_numpy()[-1] and count >= INDEX_WORDS:
            yield work(held)
            held, count = [], 0
        starts = np.flatnonzero(np.concatenate(([False], key[1:] != key[:-1])))
        cum = np.cumsum(batch.column("n").to_numpy().astype(np.int64) + WINDOW)
        at = 0
        for i in starts.tolist():
            if count + cum[i - 1] - (cum[at - 1] if at else 0) >= INDEX_WORDS:
                held.append(batch.slice(at, i - at))
                yield work(held)
                held, count, at = [], 0, i
        held.append(batch.slice(at))
        count += int(cum[-1] - (cum[at - 1] if at else 0))
    if held:
        yield work(held)


def _bytes(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return utf8(col.combine_chunks().view(pa.string()) if isinstance(col, pa.ChunkedArray) else col.view(pa.string()))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments cut into single windows, keyed by the window."""
    for part in slices(batches, "seg"):
        buf, off = _bytes(part.column("seg"))
        s, e, of = words(buf, off, _IS_WORD)
        ids = word_hashes(buf, s, e)
        n = part.column("n").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(part.num_rows), n)
        j = _ragged(np.zeros(len(n), np.int64), n)
        first = np.searchsorted(of, np.arange(part.num_rows))[row] + j
        h1, h2 = _hash_runs(ids, first, np.full(len(first), WINDOW))
        yield pa.RecordBatch.from_arrays(
            [pa.array(h1), pa.array(h1), pa.array(h2), pa.array(part.column("id").to_numpy()[row]), pa.array(part.column("pos").to_numpy()[row] + j),
             pa.array(np.ones(len(row), np.int32)), _binary(buf, s[first], e[first + WINDOW - 1])],
            ["anchor", "h1", "h2", "id", "pos", "n", "seg"],
        )


def _verdicts(segments: DataFrame) -> DataFrame:
    """All places of segments -> verdicts of the distinct ones."""
    place = F.struct("id", "pos")
    distinct = segments.groupBy("anchor", "h1", "h2").agg(
        F.min(place).alias("p"), F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.first("seg").alias("seg")
    )
    distinct = distinct.select(F.col("anchor").alias("key"), "anchor", "h1", "h2", "p.id", "p.pos", "times", "n", "seg")
    dealt = distinct.repartition("key").sortWithinPartitions("key")
    return map_arrow(dealt, _judge, "anchor bigint, h1 bigint, h2 bigint, id bigint, pos bigint, mask bigint")


def _removals(segments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, pos, mask) of the places that lose windows: all of them but at the earliest place, there those of the mask."""
    v = verdicts.select("anchor", "h1", "h2", F.col("id").alias("_id"), F.col("pos").alias("_pos"), "mask")
    at_first = (F.col("id") == F.col("_id")) & (F.col("pos") == F.col("_pos"))
    every = F.expr("shiftleft(1L, n) - 1")
    out = segments.drop("seg").join(v, ["anchor", "h1", "h2"])
    return out.select("id", "pos", F.when(at_first, F.col("mask")).otherwise(every).alias("mask")).where("mask <> 0")


def _listed(anchors: DataFrame) -> np.ndarray:
    return np.sort(anchors.select("anchor").toArrow()["anchor"].to_numpy())


def _same(part: pa.RecordBatch) -> pa.RecordBatch:
    return part


def _once(part: pa.RecordBatch) -> pa.RecordBatch:
    """The distinct rows (anchor, h1, h2) of a batch."""
    new = pa.Table.from_batches([part]).group_by(["anchor", "h1", "h2"]).aggregate([]).combine_chunks()
    return new.to_batches()[0] if new.num_rows else part.slice(0, 0)


def _among(spark: SparkSession, anchors: np.ndarray, f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f of the rows whose anchor is one of the sorted ones."""
    known = spark.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            a, names = part.column("anchor").to_numpy(), known.value
            some = np.flatnonzero(names[np.minimum(np.searchsorted(names, a), len(names) - 1)] == a) if len(names) else np.zeros(0, np.int64)
            if len(some):
                yield f(part.take(pa.array(some)))

    return run


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, mask): window pos + i of document id goes if bit i of mask is set."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    seen = map_arrow(rows, _anchors, "anchor bigint, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    bits = spark.sparkContext.broadcast(sieve(seen, "anchor", SIEVE_BITS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            t = Text(part.column("text"))
            h, first, n, of = t.runs()
            some = np.flatnonzero(in_sieve(bits.value, h, SIEVE_BITS)) if len(h) else np.zeros(0, np.int64)
            if not len(some):
                continue
            h, first, n, of = h[some], first[some], n[some], of[some]
            h1, h2 = _hash_runs(t.ids, first, n + WINDOW - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(h1), pa.array(h2), pa.array(part.column("id").to_numpy()[of]), pa.array(first - t.at[of]),
                 pa.array(n.astype(np.int32)), _binary(t.buf, t.s[first], t.e[first + n + WINDOW - 2])],
                ["anchor", "h1", "h2", "id", "pos", "n", "seg"],
            )

    segments = materialise(map_arrow(rows, cut, SEGMENT), "segments")
    # anchors in many places first, then those of them with many different segments; both lists hold at most a CAP-th as many anchors as there are segments
    many = _listed(segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(f"k > {CAP}"))
    distinct = map_arrow(segments.select("anchor", "h1", "h2"), _among(spark, many, _once), "anchor bigint, h1 bigint, h2 bigint").distinct()
    hot = _listed(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(f"k > {CAP}")) if len(many) else many
    if not len(hot):
        return materialise(_removals(segments, materialise(_verdicts(segments), "verdicts")), "removals")
    usual = segments.join(F.broadcast(spark.createDataFrame(pa.table({"anchor": hot}))), "anchor", "left_anti")
    # copies of a segment become one row before it is cut; but for the earliest, they lose all their windows
    place = F.struct("id", "pos")
    own = map_arrow(segments, _among(spark, hot, _same), SEGMENT)
    own = materialise(own.groupBy("anchor", "h1", "h2").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.first("seg").alias("seg")), "hot-segments")
    single = materialise(map_arrow(own.select("anchor", "h1", "h2", "p.id", "p.pos", "n", "seg"), _windows, SEGMENT), "windows")
    copies = own.where("times > 1").select("anchor", "h1", "h2", "p.id", "p.pos", F.lit(0).cast("long").alias("mask"))
    whole = materialise(_verdicts(usual), "verdicts").unionByName(copies)
    parts = [_removals(segments, whole), _removals(single, materialise(_verdicts(single), "verdicts"))]
    return materialise(parts[0].unionByName(parts[1]), "removals")


_RESULT = ["id", "n_words", "n_removed", "kept"]


def _finish(part: pa.RecordBatch, places: pa.Array | None) -> pa.RecordBatch:
    """places: a list of (pos, mask) for each row, or null."""
    t = Text(part.column("text"))
    cover = np.zeros(len(t.ids) + 1, np.int64)
    if places is not None:
        found = places.flatten()
        row = pc.list_parent_indices(places).to_numpy()
        pos, mask = t.at[row] + found.field("pos").to_numpy(), found.field("mask").to_numpy()
        for j in range(int(np.bitwise_or.reduce(mask)).bit_length() if len(mask) else 0):
            # at most one window starts at a word of a text, whoever says so
            start = np.unique(pos[(mask >> j & 1 > 0) & (pos + j + WINDOW <= t.at[row + 1])] + j)
            cover[start] += 1
            cover[start + WINDOW] -= 1
    keep = np.cumsum(cover[:-1]) == 0
    n = np.diff(t.at)
    left = np.concatenate(([0], np.cumsum(keep)))[t.at]
    k = np.flatnonzero(keep)
    size = t.e[k] - t.s[k] + 1  # a word and a space, but after a text's last one
    ends = np.concatenate(([0], np.cumsum(size)))
    some = left[1:] > left[:-1]
    flat = t.buf[np.minimum(_ragged(t.s[k], size), max(len(t.buf) - 1, 0))]
    flat[ends[1:] - 1] = 32
    last = np.zeros(len(flat), bool)
    last[ends[left[1:][some]] - 1] = True
    off = np.concatenate(([0], ends[left[1:]] - np.cumsum(some))).astype(np.int32)
    texts = pa.Array.from_buffers(pa.string(), part.num_rows, [None, pa.py_buffer(off), pa.py_buffer(flat[~last])])
    return pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(n - np.diff(left), pa.int64()), texts], _RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the words left, joined by one space)."""
    spark = docs.sparkSession
    found = removals(docs, id_col, text_col)
    ids = spark.sparkContext.broadcast(sieve(found.select(F.xxhash64("id").alias("h")).distinct(), "h", ID_BITS))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long")).alias("h"), F.col(text_col).alias("text"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            some = np.flatnonzero(~in_sieve(ids.value, part.column("h").to_numpy(), ID_BITS))
            if len(some):
                yield _finish(part.take(pa.array(some)), None)

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            some = np.flatnonzero(in_sieve(ids.value, part.column("h").to_numpy(), ID_BITS)) if part.num_rows else np.zeros(0, np.int64)
            yield part.take(pa.array(some)).select(["id", "text"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield _finish(part, part.column("places"))

    schema = "id bigint, n_words bigint, n_removed bigint, kept string"
    lists = found.groupBy("id").agg(F.collect_list(F.struct("pos", "mask")).alias("places"))  # at most one entry a word
    touched = map_arrow(rows, other, "id bigint, text string").join(lists, "id", "left").select("id", "text", "places")
    touched = map_arrow(touched, apply, schema)
    return map_arrow(rows, clean, schema).unionByName(touched).withColumnRenamed("id", id_col)
