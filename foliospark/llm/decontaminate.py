"""Benchmark decontamination by winnowing.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased.  A
window is 13 consecutive words of an item (an item of fewer, but not none, is
one window); every document word inside any occurrence of a window is hit.

Fingerprints: of the 7-word hashes in each 13-word window the smallest is kept
(the first of equals), so two texts that share a window keep the same hash for
it: no shared span of 13 words is missed.  Kept document fingerprints are
looked up among the items' and every window around a match is then compared
word by word (64-bit word ids).  Items below 13 words are compared at every position.

Up to BLOCK_BYTES of benchmark text its windows are broadcast as an index, and
nothing is shuffled.  Beyond, windows are cut in parallel and stay in Spark: the
documents' winnowed windows that pass two sieves of fixed size meet them in a
shuffle by 64-bit hashes (large partitions can be split), and ids and texts are
written once with a number of each row.  Both ways give the same rows.  Null
texts have no words and no hits; empty items never occur; repeated items or ids
each count (items as a set of ids), null ids as well: every input row gives one.
An empty benchmark hits nothing, an empty table gives no rows.  Clashing column
names do no harm: only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_minima, gram_hashes, in_sieve, map_arrow, materialise, mix, numbered, row_hashes, sieve, slices, utf8, word_hashes, words
from .exact_dedup import row_key, without_rows

WINDOW, K = 13, 7
BLOCK_BYTES = 16 << 20
PRINT_BITS, KEY_BITS = 24, 26

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The id of each word and the offsets of each text in them."""
    buf, off = utf8(texts)
    buf = _LOWER[buf]
    s, e, of = words(buf, off, _IS_WORD)
    at = np.searchsorted(of, np.arange(len(texts) + 1))
    return word_hashes(buf, s, e), at


def winnow(ids: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of words the place of its smallest k-gram hash (the first of equals), and the hashes."""
    g = gram_hashes(ids, k)
    return first_minima(g, window - k + 1), g


def item_windows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, words of each window, number of its text) of the windows of items, by their size."""
    ids, at = word_ids(texts)
    count = np.diff(at)
    size = np.minimum(count, WINDOW)
    for n in np.unique(size[size > 0]).tolist():
        some = np.flatnonzero(size == n)
        each = count[some] - n + 1
        item = np.repeat(some, each)
        starts = at[item] + np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each)
        yield n, ids[starts[:, None] + np.arange(n)], item


def fingerprints(rows: np.ndarray) -> np.ndarray:
    """The kept fingerprint of each window of WINDOW words: its smallest hash of K words."""
    return np.stack([row_hashes(rows[:, j : j + K]) for j in range(WINDOW - K + 1)], axis=1).min(axis=1)


class Index:
    """Windows and fingerprints of a block of items."""

    def __init__(self, item_ids: list[str], texts: pa.Array):
        self.names = item_ids
        self.by_size = {}
        prints = np.zeros(0, np.uint64)
        for n, rows, item in item_windows(texts):
            h = row_hashes(rows)
            order = np.lexsort((item, h))
            h, item = h[order], item[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            self.by_size[n] = (h[first], rows[order[first]], np.split(item, first[1:]))
            if n == WINDOW:
                prints = np.unique(fingerprints(rows))
        self.prints = prints
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[prints >> np.uint64(44)] = True

    def windows(self, ids: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, starts, number of the index's window) of all occurrences within texts."""
        last = np.zeros(len(ids) + 1, np.int64)
        last[: len(ids)] = np.repeat(at[1:], np.diff(at))
        for n, (h, rows, _) in self.by_size.items():
            if len(ids) < n:
                continue
            if n == WINDOW:
                place, g = winnow(ids, WINDOW, K)
                kept = np.zeros(len(g), bool)
                kept[place] = True
                kept &= self.sieve[g >> np.uint64(44)]
                p = np.flatnonzero(kept)
                i = np.searchsorted(self.prints, g[p])
                i[i == len(self.prints)] = 0
                match = np.zeros(len(g), bool)
                match[p[self.prints[i] == g[p]]] = True
                starts = np.flatnonzero(match[place])
                starts = starts[starts + n <= last[starts]]
                if not len(starts):
                    continue
                around = ids[starts[:, None] + np.arange(n)]
                key = row_hashes(around)
            else:
                starts = np.flatnonzero(np.arange(len(ids) - n + 1) + n <= last[: len(ids) - n + 1])
                key = gram_hashes(ids, n)[starts]
            i = np.searchsorted(h, key)
            i[i == len(h)] = 0
            hit = h[i] == key
            starts, i = starts[hit], i[hit]
            same = (rows[i] == ids[starts[:, None] + np.arange(n)]).all(axis=1)
            yield n, starts[same], i[same]


def _hits(index: Index, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[np.ndarray]]:
    """Per text: number of words, hit spans of words (end exclusive, disjoint), numbers of items."""
    ids, at = word_ids(texts)
    cover = np.zeros(len(ids) + 1, np.int64)
    items: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for n, starts, which in index.windows(ids, at):
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + n, -1)
        of = np.searchsorted(at, starts, side="right") - 1
        pairs = np.unique(of.astype(np.uint64) << np.uint64(32) | which.astype(np.uint64))
        lists = index.by_size[n][2]
        for pair in pairs.tolist():
            items[pair >> 32].append(lists[pair & 0xFFFFFFFF])
    on = np.cumsum(cover[:-1]) > 0
    spans = []
    for i in range(len(texts)):
        if not items[i]:
            spans.append([])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], on[at[i] : at[i + 1]].view(np.int8), [0]))))
        spans.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return np.diff(at), spans, [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in items]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, spans array<struct<start,end>> of hit words, items array<string> sorted."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).where("item is not null")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if (items.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0) > block_bytes:
        return _joined(rows, items).withColumnRenamed("id", id_col)
    table = items.toArrow()
    index = spark.sparkContext.broadcast(Index(table["item"].to_pylist(), table["text"].combine_chunks() if len(table) else pa.array([], pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, spans, found = _hits(index.value, part.column("text"))
            names = [sorted({index.value.names[i] for i in f.tolist()}) for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n, pa.int64()), pa.array([[{"start": a, "end": z} for a, z in s] for s in spans], _SPAN), pa.array(names, pa.list_(pa.string()))],
                ["id", "n_words", "spans", "items"],
            )

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, spans {_SPANS}, items array<string>"
    return map_arrow(rows, run, schema).withColumnRenamed("id", id_col)


_SPANS = "array<struct<start:bigint,`end`:bigint>>"


def _key(n: int, h: np.ndarray) -> np.ndarray:
    """Key of windows of n words."""
    return mix(h + np.uint64(n)).view(np.int64)


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """contamination() for a benchmark of any size: what passes two sieves of fixed size meets its windows in a shuffle."""
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for n, rows, item in item_windows(part.column("text")):
                prints = fingerprints(rows) if n == WINDOW else np.zeros(len(rows), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), n, np.int32)), pa.array(_key(n, row_hashes(rows))), pa.array(prints.view(np.int64)), part.column("item").take(pa.array(item))],
                    ["n", "key", "print", "item"],
                )

    windows = materialise(map_arrow(items.select("item", "text"), cut, "n int, key long, print long, item string").distinct(), "benchmark-windows")
    sizes = [r["n"] for r in windows.select("n").distinct().collect()]  # at most WINDOW numbers
    known = spark.sparkContext.broadcast((sieve(windows.where(f"n = {WINDOW}"), "print", PRINT_BITS), sieve(windows, "key", KEY_BITS)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, keys = known.value
        for part in slices(batches, "text"):
            ids, at = word_ids(part.column("text"))
            last = np.repeat(at[1:], np.diff(at))
            for n in sizes:
                whole = np.arange(max(len(ids) - n + 1, 0)) + n <= last[: max(len(ids) - n + 1, 0)]
                if n == WINDOW:
                    place, g = winnow(ids, WINDOW, K)
                    whole[whole] &= in_sieve(prints, g[place[whole]], PRINT_BITS)
                starts = np.flatnonzero(whole)
                key = _key(n, gram_hashes(ids, n)[starts])
                some = in_sieve(keys, key, KEY_BITS)
                starts, key = starts[some], key[some]
                of = np.searchsorted(at, starts, side="right") - 1
                yield pa.RecordBatch.from_arrays([part.column("_row").take(pa.array(of)), pa.array(starts - at[of]), pa.array(np.full(len(of), n, np.int32)), pa.array(key)], ["_row", "start", "n", "key"])

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("_row"), pa.array(np.diff(word_ids(part.column("text"))[1]))], ["id", "_row", "n_words"])

    rows = numbered(docs, "contamination-rows")
    hits = materialise(map_arrow(rows.select("_row", "text"), look, "_row long, start long, n int, key long").join(windows.select("key").distinct(), "key"), "contamination-hits")
    # a document's own hits: at most one a word and size
    spans = hits.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    names = hits.select("_row", "key").distinct().join(windows.select("key", "item").distinct(), "key").groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sized = map_arrow(rows, size, f"id {rows.schema['id'].dataType.simpleString()}, _row long, n_words long")
    out = sized.join(spans, "_row", "left").join(names, "_row", "left")
    merged = F.aggregate("spans", F.expr(f"cast(array() as {_SPANS})"), _join_span)
    return out.select("id", "n_words", F.coalesce(merged, F.expr(f"cast(array() as {_SPANS})")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def _join_span(acc, s):
    last = F.try_element_at(acc, F.lit(-1))
    joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
    return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), joined).otherwise(F.concat(acc, F.array(s)))


def n_hit(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def is_contaminated(spans, n_words):
    """At least a twentieth of the words is hit."""
    return (n_hit(spans) > 0) & (20 * n_hit(spans) >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones; null and shared ids are told apart by their texts."""
    found = contamination(docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")), benchmark, "key")
    return without_rows(docs, found.where(is_contaminated(F.col("spans"), F.col("n_words"))).select("key.*"), id_col, text_col)
