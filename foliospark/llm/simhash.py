"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, 3-word shingles with
repeats, joined by one space (fewer words: the whole sequence; none, or a null
text: fingerprint zero); a bit is 1 if set in over half of the shingles'
XXH64 (seed 42).  Fingerprints that differ in 3 bits or fewer are linked, and
components of links are classes; the smallest id in a class names it.

Covering: every bit gets a non-zero vector of 4 bits; table v (15 of them)
keeps the bits whose vector has an odd product with v.  For any 3 bits some v
is even to all, so every pair within the radius agrees in some table; none is
missed.  Copies collapse to one row per fingerprint first.

A bucket (table and kept bits, about 34) above BUCKET fingerprints is split by
the same construction over its other bits, into 15 more tables of about 16
bits; what is left then has at most 2**16 fingerprints, so no task gets an
unbounded group.  Inside a bucket only a spanning forest of the links comes
out, so rows stay linear in the bucket.  Ids are integers; rows with a null id
get a fingerprint and no class of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, slices, utf8, words
from .components import components
from .exact_dedup import row_key, without_rows

RADIUS, BUCKET, SEED, SHINGLE = 3, 2048, 42, 3

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


#: the bits of a byte as the bytes of a number
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _bit_sums(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each run of n hashes: bytes count up to 255, then runs of those are added."""
    part = -(-n // 255)
    doc = np.repeat(np.cumsum(n) - n, part)
    at = doc + 255 * (np.arange(len(doc)) - np.repeat(np.cumsum(part) - part, part))
    octets = h.view(np.uint8).reshape(-1, 8)
    sums = np.empty((len(at), 8), np.uint64)
    for j in range(8):
        sums[:, j] = np.add.reduceat(_LANES[octets[:, j]], at)
    return np.add.reduceat(sums.view(np.uint8).astype(np.int64), np.cumsum(part) - part, axis=0)


def fingerprint_array(texts: pa.Array) -> np.ndarray:
    """uint64 fingerprint of each text."""
    buf, off = utf8(texts)
    buf = _LOWER[buf]
    s, e, of = words(buf, off, _IS_WORD)
    out = np.zeros(len(texts), np.uint64)
    if not len(s):
        return out
    # keep the words and one space before each but the first of the slice: shingles are then runs of bytes
    keep = _IS_WORD[buf]
    gap = s[1:][s[1:] > e[:-1]] - 1
    keep[gap] = True
    new = np.cumsum(keep) - 1
    b = buf[keep].tobytes()
    ns, ne = new[s], new[e - 1] + 1
    first = np.searchsorted(of, np.arange(len(texts)))
    count = np.bincount(of, minlength=len(texts))
    shingles = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), shingles)
    start = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    end = np.minimum(start + SHINGLE, first[doc] + count[doc]) - 1
    f = xxhash.xxh64_intdigest
    h = np.fromiter((f(b[x:y], SEED) for x, y in zip(ns[start].tolist(), ne[end].tolist(), strict=True)), np.uint64, len(doc))
    some = shingles[shingles > 0]
    major = 2 * _bit_sums(h, some) > some[:, None]
    out[shingles > 0] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            fp = fingerprint_array(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp bigint")


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """2**(radius+1) - 1 masks over the given bits; any `radius` of the bits are all outside some mask."""
    dims = radius + 1
    vector = {bit: i % (2**dims - 1) + 1 for i, bit in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, 2**dims)]


FIRST = covering_masks(list(range(64)))
SECOND = [[m | x for x in covering_masks([b for b in range(64) if not m >> b & 1])] for m in FIRST]
_NEAR = [sum(1 << b for b in c) for n in range(1, RADIUS + 1) for c in itertools.combinations(range(16), n)]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def spanning(fp: np.ndarray) -> np.ndarray:
    """Label of each of the distinct fingerprints of one bucket: the same for those that links join."""
    n = len(fp)
    vary = int(np.bitwise_or.reduce(fp ^ fp[0]))
    if n > 256 and vary.bit_count() <= 16:
        cell = np.zeros(n, np.int64)
        for i, b in enumerate(b for b in range(64) if vary >> b & 1):
            cell |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
        grid = np.full(1 << 16, n, np.int64)
        grid[cell] = np.arange(n)
        label = np.arange(n)
        while True:
            spread = grid.copy()
            spread[cell] = label
            new = label.copy()
            for x in _NEAR:
                np.minimum(new, spread[cell ^ x], out=new)
            new = new[new]
            if (new == label).all():
                return label
            label = new
    label = np.arange(n)
    near = np.concatenate([np.bitwise_count(fp[i : i + 256, None] ^ fp[None, :]) <= RADIUS for i in range(0, n, 256)])
    while True:
        new = np.concatenate([np.where(near[i : i + 256], label[None, :], n).min(axis=1) for i in range(0, n, 256)])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, fp, rep) sorted by (t, key) -> links (a, b) of reps."""
    rest: list[np.ndarray] | None = None

    def work(cols: list[np.ndarray]) -> pa.RecordBatch:
        t, key, fp, rep = cols
        cut = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]), [True])))
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        a, b = [rep[two]], [rep[two + 1]]
        for i in np.flatnonzero(size > 2).tolist():
            r = rep[cut[i] : cut[i + 1]]
            label = spanning(fp[cut[i] : cut[i + 1]])
            own = label != np.arange(len(r))
            a.append(r[own])
            b.append(r[label[own]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols[2] = cols[2].view(np.uint64)
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = [c[cut:] for c in cols]
        if cut:
            yield work([c[:cut] for c in cols])
    if rest is not None and len(rest[0]):
        yield work(rest)


def _bucket_links(rows: DataFrame) -> DataFrame:
    return map_arrow(rows.repartition("t", "key").sortWithinPartitions("t", "key", "rep").select("t", "key", "fp", "rep"), _links, "a bigint, b bigint")


def _classes(fps: DataFrame) -> DataFrame:
    """fps (id, fp) -> (fp, component_id)."""
    reps = materialise(fps.where("id is not null").groupBy("fp").agg(F.min("id").cast("long").alias("rep")), "simhash-reps")
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(FIRST)])
    rows = reps.select("rep", "fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp", "rep")
    hot = materialise(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {BUCKET}").select("t", "key"), "simhash-hot")
    second = F.array(*[F.array(*[F.lit(_signed(x)) for x in row]) for row in SECOND])
    finer = F.posexplode(F.element_at(second, F.col("t") + 1)).alias("u", "mask")
    split = (
        rows.join(hot, ["t", "key"], "left_semi").select("t", "fp", "rep", finer)
        .select((15 + F.col("t") * 15 + F.col("u")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep")
    )
    usual = rows.join(hot, ["t", "key"], "left_anti")
    links = _bucket_links(usual.unionByName(split))
    classes = components(links)
    named = reps.join(classes, reps["rep"] == classes["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return materialise(named, "simhash-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fp long, component_id."""
    fps = materialise(fingerprints(docs, id_col, text_col), "simhash")
    return fps.join(_classes(fps), "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, that with the smallest id.

    A row without an id goes if a row with its fingerprint has one, else it
    stays.  Rows that share the smallest id of a class all stay.  Classes are
    linked by ids: where an id is the smallest of several fingerprints, these
    are one class.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    fps = materialise(fingerprints(keyed, "key").select("id.*", "fp"), "simhash")
    found = fps.join(_classes(fps), "fp", "left")
    return without_rows(docs, found.where("component_id is not null and not (id <=> component_id)").select("id", "h0", "h1"), id_col, text_col)
