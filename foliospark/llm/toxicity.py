"""Toxicity by two class-conditional Kneser-Ney models over words and pairs of words, with a shared lower order.

Events are counted once a document.  q_c(w) is the share of word w among the
events of class c, n_c(vw) the documents of the class with w after v, q_c(w | v)
its share after v, m the smaller of the classes' events N_t and N_o:

    shared(w)  = (N(.w) - d + d V / (V + 1)) / N(..)          continuation counts of both classes: N(.w) words
                                                               (or starts) that w follows, told apart by document
    P_c(w)     = e_c(w) + b_c shared(w)                        e_c(w) = max(q_c(w) - D_c(w), 0)
    P_c(w | v) = e_c(vw) + b_c(v) P_c(w)                       e_c(vw) = max(q_c(w | v) - D_c(vw), 0)

b is the mass that discounting frees, so each is a distribution.  There are two
such pairs of models over the same counts, of all words and all pairs of words:

whole    each class is discounted by WHOLE_DISCOUNT documents, less than 1: every
         word and every pair that a class has seen keeps a share of its own
marked   both classes are discounted at one rate: by DISCOUNT / m of a class's
         events (PAIR_DISCOUNT documents of the smaller class for pairs, in
         proportion more of the other), and at least by RATIO times what the other
         class (for pairs: also the class's own lower order) leads to expect; what
         is rare or unremarkable in a class has only the shared estimate in it

A text's ratio is the difference of its two log-likelihoods, over all its words,
divided by their number.  A logistic curve over the ratios of both, fitted on
held-back labelled rows with models that have not seen them, turns them into 0
to 1: so it is measured, not set, what the words and pairs that RATIO leaves out
are worth.  The constants were chosen by the likelihood of held-back rows among
the learning folds.

Every labelled row counts; the counts grow with the corpus and stay in Spark.
Up to NUMBERED_WORDS words are numbered, the commonest first, and their counts
are broadcast.  Pairs are then dealt by context over shards (those of common
contexts over several) and kept packed: one table of counts for each shard.  The
pairs of the texts that are scored are dealt and packed in the same way, meet
the table of their shard, whose gains are made on the spot, and come back as a
sum for each text and task.  Texts are told by a hash; shuffles end with the
table that they were made for.  Model.gains lists the same gains as rows.
Beyond NUMBERED_WORDS pairs go by hashes, with the same counts, and what goes to
the tasks is a table of corrections to the constant: of words, of contexts and of
pairs.  Up to TABLE_ROWS it is (the marked model's always goes so) broadcast; beyond, so
many of the keys that most documents have are, and keys of the texts that pass a
sieve of the others meet them in a shuffle (large partitions can be split), with
the same sums.  Only the curve (three numbers) is fitted on a bounded sample:
CURVE_ROWS labelled rows.

Words are runs of letters and of characters beyond ASCII, lower-cased, told by
64-bit hashes.  Null or empty texts have no words and a raw score of 0; without
labels of both kinds, or no rows at all, every score is 0.  Labels repeated for
an id: toxic if any says so; null labels are none.  Rows that repeat an id, or
have none, are scored each by its own text; equal texts have equal scores.  Other
columns are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _give_back, in_sieve, map_arrow, materialise, mix, numbered, pack, sieve, slices, unpack, utf8, word_hashes, words

DISCOUNT, PAIR_DISCOUNT, RATIO, SHARED_DISCOUNT = 2.0, 16.0, 12.0, 0.75
#: below 1, so that whatever was seen once keeps a share
WHOLE_DISCOUNT = 0.75
#: corrections (16 bytes each) up to which their table is broadcast
TABLE_ROWS = 1_000_000
CURVE_ROWS = 50_000
#: labels (12 bytes each) up to which they are broadcast to the documents; beyond it both are shuffled by id
BROADCAST_LABELS = 1_000_000
SIEVE_BITS = 27
#: words up to which they are numbered
NUMBERED_WORDS = 2_000_000
#: bits of a word's number, and of a row's in a slice of TEXT_BYTES
_WORD_BITS, _ROW_BITS = 21, 22
TEXT_BYTES = 4 << 20
#: labelled pairs (once a document) for each shard of numbered pairs, and shards at least
SHARD_EVENTS, LEAST_SHARDS = 1 << 20, 64
#: sums that a task holds before it passes them on
HELD_SUMS = 4 << 20
#: slope and offset of the marked model alone, where held-back rows are of one kind only
CURVE = (100.0, -2.0)
#: of the marked and the whole model, chosen by the likelihood of held-back rows among the learning folds
RIDGE = (1e-2, 1.0)

#: the context of a text's first word, and what sets keys of contexts and of pairs apart from those of words
_START, _CONTEXT, _PAIR = 0x5EED5EED5EED5EED, 0x1B873593CC9E2D51, 0x27D4EB2F165667C5

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


@dataclass(frozen=True)
class Discounts:
    words: float
    pairs: float
    #: times what the other class leads to expect
    ratio: float
    #: the same share of both classes' events, or the same number of documents
    alike: bool


MARKED, WHOLE = Discounts(DISCOUNT, PAIR_DISCOUNT, RATIO, True), Discounts(WHOLE_DISCOUNT, WHOLE_DISCOUNT, 0.0, False)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of the word before it (or of the start), and the text that it stands in."""
    buf, off = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    s, e, of = words(buf, off, _IS_WORD)
    w = word_hashes(buf, s, e).view(np.int64)
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[np.flatnonzero(np.diff(of, prepend=-1))] = _START
    return w, before, of


def _pair_key(before: np.ndarray, w: np.ndarray) -> np.ndarray:
    v = before.view(np.uint64)
    return ((v << np.uint64(23) | v >> np.uint64(41)) ^ w.view(np.uint64) ^ np.uint64(_PAIR)).view(np.int64)


def _pair_column() -> Column:
    turned = F.shiftleft("before", 23).bitwiseOR(F.shiftrightunsigned("before", 41))
    return turned.bitwiseXOR(F.col("word")).bitwiseXOR(F.lit(_PAIR))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, toxic) of the documents that have a label."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    if labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id")


_KINDS = ("t0", "o0", "t1", "o1")
_LONGS = ", ".join(f"{k} long" for k in _KINDS)


class Events:
    """What the texts of a batch hold, once a document: words, and words after words, with kinds (class and part) of the documents."""

    def __init__(self, part: pa.RecordBatch):
        w, before, of = _words(part.column("text"))
        self.w, self.before, self.of, self.rows = w, before, of, part.num_rows
        self.kind = part.column("part").to_numpy() * 2 + 1 - part.column("toxic").to_numpy().clip(0, 1)

    def once(self, key: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of a word with each distinct key, number of the key and kind of each event) among some words."""
        code, _ = pd.factorize(key[some])
        event = np.unique(code * self.rows + self.of[some])
        at = np.empty(int(code.max()) + 1 if len(code) else 0, np.int64)
        at[code] = some
        return at, event // self.rows, self.kind[event % self.rows]

    def counts(self, n: int, code: np.ndarray, kind: np.ndarray) -> list[pa.Array]:
        found = np.bincount(code * 4 + kind, minlength=4 * n).reshape(n, 4)
        return [pa.array(np.ascontiguousarray(found[:, k])) for k in range(4)]


_AFTER = tuple(f"after_{k}" for k in _KINDS)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, part, text) -> (word, t0, o0, t1, o1, c0, c1, after_...): documents by class and part, continuations by part,
    events with the word (or the start of a text) as context."""
    for part in slices(batches, "text", TEXT_BYTES):
        e = Events(part)
        code, names = pd.factorize(np.concatenate([e.w, e.before]))
        own, context, n = code[: len(e.w)], code[len(e.w) :], len(names)
        word = np.unique(own * e.rows + e.of)
        of_word = np.bincount(word // e.rows * 4 + e.kind[word % e.rows], minlength=4 * n).reshape(n, 4)
        event = np.unique((context * n + own) * e.rows + e.of)
        pair, kind = event // e.rows, e.kind[event % e.rows]
        c = np.bincount(pair % n * 2 + (kind >> 1), minlength=2 * n).reshape(n, 2) if n else np.zeros((0, 2), np.int64)
        after = np.bincount(pair // n * 4 + kind, minlength=4 * n).reshape(n, 4) if n else np.zeros((0, 4), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(np.ascontiguousarray(x[:, k])) for x in (of_word, c, after) for k in range(x.shape[1]))], ["word", *_KINDS, "c0", "c1", *_AFTER])


@dataclass(frozen=True)
class Counts:
    #: (word, t0, o0, t1, o1, c0, c1)
    words: DataFrame
    #: (before, word, t0, o0, t1, o1)
    pairs: DataFrame
    #: (before, t0, o0, t1, o1): events after each context
    contexts: DataFrame
    #: the pairs by numbers of words, where there are not too many words
    shards: Shards | None = None

    def frequent(self, docs: float) -> DataFrame:
        """Pairs of more than so many documents of a class."""
        if self.shards:
            return self.shards.pairs(docs)
        return self.pairs.where((F.col("t0") + F.col("t1") > docs) | (F.col("o0") + F.col("o1") > docs))


#: the two models: (toxic, ordinary, continuations) as sums of columns
PARTS = (("t0", "o0", "c0"), ("t0 + t1", "o0 + o1", "c0 + c1"))


def _pack_pairs(code: np.ndarray, *more: np.ndarray) -> bytes:
    """Distinct pairs (context << _WORD_BITS | word) in order, as differences, and more arrays."""
    v, w = code >> _WORD_BITS, code & (1 << _WORD_BITS) - 1
    dv, dw = np.diff(v, prepend=0), np.diff(w, prepend=0)
    return pack(dv, np.where(dv > 0, w, dw), *more)


def _unpack_pairs(blob: bytes) -> list[np.ndarray]:
    dv, dw, *more = unpack(blob)
    first = dv > 0
    first[:1] = True
    at, sums = np.flatnonzero(first), np.cumsum(dw)
    w = sums - (sums[at] - dw[at])[np.cumsum(first) - 1]
    return [np.cumsum(dv) << _WORD_BITS | w, *more]


def _by_shard(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(first column, rows of the others) of rows that are sorted by the first."""
    rows = (r for part in batches for r in zip(*(part.column(c).to_pylist() for c in columns), strict=True))
    for key, some in groupby(rows, lambda r: r[0]):
        yield key, (r[1:] for r in some)


class Numbers:
    """Numbers of words, the commonest first, by hash; the start of a text has the number after the last.

    split: over how many shards a context's pairs are dealt. Sent packed: files of a broadcast lie on the disk of each machine.
    """

    def __init__(self, names: np.ndarray, split: np.ndarray, shards: int):
        order = np.argsort(names)
        self.hashes, self.numbers, self.names, self.split, self.shards = names[order], order.astype(np.int32), np.append(names, _START), split, shards

    def __reduce__(self):
        return _numbers, (pack(self.names[:-1], self.split), self.shards)

    def of(self, w: np.ndarray) -> np.ndarray:
        """-1 for words that have none."""
        if not len(self.hashes):
            return np.full(len(w), -1)
        at = np.searchsorted(self.hashes, w)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == w, self.numbers[at], -1).astype(np.int64)

    def events(self, w: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of each word and of its context."""
        code, names = pd.factorize(w)
        n = self.of(names)[code]
        before = np.empty_like(n)
        before[1:] = n[:-1]
        before[np.flatnonzero(np.diff(of, prepend=-1))] = len(self.hashes)
        return n, before

    def deal(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order of pairs by shard, ends of the shards). A context's pairs stand in one shard, those of a common one in several."""
        v, w = code >> _WORD_BITS, code & (1 << _WORD_BITS) - 1
        part = mix(w.astype(np.uint64)) % self.split[v].astype(np.uint64)
        shard = ((mix(v.astype(np.uint64)) % np.uint64(self.shards) + part) % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(shard.astype(np.uint16) if self.shards <= 1 << 16 else shard, kind="stable")
        return order, np.cumsum(np.bincount(shard, minlength=self.shards))


def _numbers(blob: bytes, shards: int) -> Numbers:
    return Numbers(*unpack(blob), shards)


class Rates:
    """What is counted of each word and of the start, by number; and what the whole models make of it.

    Columns: documents by kind, continuations by part, events after it by kind, words that follow it by class for each of PARTS.
    """

    def __init__(self, counts: list[np.ndarray]):
        self.counts = counts
        self._words: dict[int, tuple] = {}
        self._contexts: dict[int, tuple] = {}

    def __reduce__(self):
        return _rates, (pack(*self.counts),)

    def _both(self, first: int, part: int) -> list[np.ndarray]:
        return [(self.counts[k].astype(float) + self.counts[k + 2] if part else self.counts[k].astype(float)) for k in (first, first + 1)]

    def free(self, part: int) -> tuple[float, float] | None:
        """What discounts of words free in both classes; None where a class has no words."""
        out = []
        for x in self._both(0, part):
            n = x.sum()
            x -= WHOLE_DISCOUNT
            out.append(1 - np.maximum(x, 0, out=x).sum() / n if n else 0.0)
        return (out[0], out[1]) if all(out) else None

    def words(self, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pt, po, gain) by word."""
        if part not in self._words:
            t, o = (x[:-1] for x in self._both(0, part))
            n, seen, free = sum(x[:-1].astype(float) for x in self.counts[4 : 5 + part]), t + o > 0, self.free(part)
            size = int(seen.sum())
            shared = (n - SHARED_DISCOUNT + SHARED_DISCOUNT * size / (size + 1)) / n[seen].sum()
            pt, po = (np.where(seen, np.maximum(x - WHOLE_DISCOUNT, 0) / x.sum() + b * shared, 1.0) for x, b in zip((t, o), free, strict=True))
            self._words[part] = pt, po, np.where(seen, np.log(pt / po) - np.log(free[0] / free[1]), 0.0)
        return self._words[part]

    def contexts(self, part: int) -> tuple[np.ndarray, ...]:
        """(ct, co, bt, bo, gain) by context."""
        if part not in self._contexts:
            ct, co = self._both(6, part)
            bt, bo = (np.where(x > 0, WHOLE_DISCOUNT * self.counts[10 + 2 * part + c] / np.maximum(x, 1), 1.0) for c, x in enumerate((ct, co)))
            self._contexts[part] = ct, co, bt, bo, np.log(bt / bo)
        return self._contexts[part]


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if x.max(initial=0) < 1 << 31 else x


def _rates(blob: bytes) -> Rates:
    return Rates([_narrow(x) for x in unpack(blob)])


@dataclass(frozen=True)
class Shards:
    """All pairs by numbers of words, in packed tables by shard."""

    #: of Numbers and of Rates
    numbers: Broadcast
    rates: Broadcast
    #: what discounts of words free, over each of PARTS
    free: tuple[tuple[float, float] | None, ...]
    #: (shard int, blob binary)
    table: DataFrame

    def pairs(self, docs: float = 0) -> DataFrame:
        """(before, word, t0, o0, t1, o1) of pairs of more than so many documents of a class."""
        known = self.numbers

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in _by_shard(batches, "shard", "blob"):
                for (blob,) in rows:
                    code, *kinds = _unpack_pairs(blob)
                    some = np.flatnonzero(np.maximum(kinds[0] + kinds[2], kinds[1] + kinds[3]) > docs)
                    for at in np.array_split(some, len(some) // 100_000 + 1):
                        names = (known.value.names[code[at] >> _WORD_BITS], known.value.names[code[at] & (1 << _WORD_BITS) - 1], *(k[at] for k in kinds))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in names], ["before", "word", *_KINDS])

        return map_arrow(self.table, named, f"before long, word long, {_LONGS}")


def _shards(rows: DataFrame, found: DataFrame) -> Shards:
    """The pairs of rows (toxic, part, text), of whose words and contexts found has the counts."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pack(*(part.column(c).to_numpy() for c in columns))], pa.binary())], ["blob"])

    columns = ("word", *_KINDS, "c0", "c1", *_AFTER)
    parts = [[x[0], *map(_narrow, x[1:])] for x in map(unpack, map_arrow(found.select(*columns), packed, "blob binary").toArrow()["blob"].to_pylist())]
    names, *counts = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64) for k in range(len(columns)))
    del parts
    # the commonest word first, the start of a text last
    order = np.lexsort((names, -sum(counts[:4]), names == _START))
    start = bool(len(order)) and names[order[-1]] == _START
    names, counts = names[order[: len(order) - start]], [x[order] if start else np.append(x[order], 0) for x in counts]
    after = sum(x.astype(np.int64) for x in counts[6:])
    total = max(int(after.sum()), 1)
    shards = max(LEAST_SHARDS, total // SHARD_EVENTS)
    # an eighth of a shard at most of one context in one shard
    split = np.minimum(1 + 8 * shards * after // total, shards)
    sc = rows.sparkSession.sparkContext
    numbers = sc.broadcast(Numbers(names, split, shards))
    size = len(after)
    del order, after, split

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for part in slices(batches, "text", TEXT_BYTES):
            e = Events(part)
            w, v = known.events(e.w, e.of)
            event = np.unique((v << _WORD_BITS | w).view(np.uint64) << np.uint64(_ROW_BITS) | e.of.view(np.uint64))
            pair = (event >> np.uint64(_ROW_BITS)).view(np.int64)
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            at = np.repeat(np.arange(len(first)), np.diff(first, append=len(pair)))
            kinds = np.bincount(at * 4 + e.kind[(event & np.uint64((1 << _ROW_BITS) - 1)).view(np.int64)], minlength=4 * len(first)).reshape(-1, 4)
            code = pair[first]
            order, ends = known.deal(code)
            some = [(k, o) for k, o in enumerate(np.split(order, ends[:-1])) if len(o)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([_pack_pairs(code[o], *(kinds[o, k] for k in range(4))) for _, o in some], pa.binary())], ["shard", "blob"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blobs in _by_shard(batches, "shard", "blob"):
            parts = [_unpack_pairs(blob) for (blob,) in blobs]
            code, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
            kinds = (np.bincount(at, weights=np.concatenate([x[k] for x in parts])).astype(np.int64) for k in range(1, 5))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_pack_pairs(code, *kinds)], pa.binary())], ["shard", "blob"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_shard(batches, "shard", "blob"):
            for (blob,) in blobs:
                code, t0, o0, t1, o1 = _unpack_pairs(blob)
                v = code >> _WORD_BITS
                first = np.flatnonzero(np.diff(v, prepend=-1))
                seen = (np.add.reduceat((x > 0).astype(np.int64), first) for x in (t0, o0, t0 + t1, o0 + o1))
                yield pa.RecordBatch.from_arrays([pa.array([pack(v[first], *seen)], pa.binary())], ["blob"])

    dealt = map_arrow(rows, counted, "shard int, blob binary").repartition("shard").sortWithinPartitions("shard")
    pairs = materialise(map_arrow(dealt, summed, "shard int, blob binary"), "toxic-pairs", once=True)
    followers = [np.zeros(size, np.int32) for _ in range(4)]
    for blob in map_arrow(pairs, follow, "blob binary").toArrow()["blob"].to_pylist():
        v, *seen = unpack(blob)
        for x, k in zip(followers, seen, strict=True):
            x[v] += k.astype(np.int32)
    rates = Rates([*counts, *followers])
    out = Shards(numbers, sc.broadcast(rates), (rates.free(0), rates.free(1)), pairs)
    del names, counts, rates, followers
    _give_back()
    return out


@dataclass(frozen=True)
class Numbered:
    """The whole model over one of PARTS, of numbered words."""

    shards: Shards
    part: int
    constant: float

    def ratios(self, texts: DataFrame) -> DataFrame:
        """texts (text_id, text) -> (text_id, ratio): each id once.

        Pairs of the texts meet the tables of pairs by shard, packed; what comes back is a sum for each text.
        """
        numbers, rates, constant, second = self.shards.numbers, self.shards.rates, self.constant, self.part

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, gain, free = numbers.value, np.append(rates.value.words(second)[2], 0.0), np.append(rates.value.contexts(second)[4], 0.0)
            for i, part in enumerate(slices(batches, "text", TEXT_BYTES)):
                h, _, of = _words(part.column("text"))
                w, v = known.events(h, of)
                total = np.bincount(of, weights=gain[w] + free[v], minlength=part.num_rows)
                both = (w >= 0) & (v >= 0)
                event, times = np.unique((v[both] << _WORD_BITS | w[both]).view(np.uint64) << np.uint64(_ROW_BITS) | of[both].view(np.uint64), return_counts=True)
                pair, row = (event >> np.uint64(_ROW_BITS)).view(np.int64), (event & np.uint64((1 << _ROW_BITS) - 1)).view(np.int64)
                order, ends = known.deal(pair)
                ids = part.column("text_id").to_numpy()
                # told by its place and by what it holds, so that a task that runs again names it alike
                named = int(mix(np.array([TaskContext.get().partitionId() << 32 | i], np.uint64) ^ np.bitwise_xor.reduce(mix(ids.view(np.uint64) + np.arange(len(ids), dtype=np.uint64))))[0] >> np.uint64(1))
                out = [(named % known.shards, 2, pack(ids, total, np.bincount(of, minlength=part.num_rows), np.array([len(event)])))]
                for k, o in enumerate(np.split(order, ends[:-1])):
                    if len(o):
                        first = np.flatnonzero(np.diff(pair[o], prepend=-1))
                        out.append((k, 1, _pack_pairs(pair[o][first], np.diff(first, append=len(o)) - 1, row[o], times[o] - 1)))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([named] * len(out), pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["shard", "kind", "slice", "blob"])

        def row(slice_: list[int], kind: list[int], blob: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(slice_, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["slice", "kind", "blob"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            held = 0

            def out() -> pa.RecordBatch:
                blobs = [pack(at := np.flatnonzero(x), x[at], np.array([n])) for n, x in sums.values()]
                return row(list(sums), [1] * len(sums), blobs)

            for _, rows in _by_shard(batches, "shard", "kind", "slice", "blob"):
                keys, gain = np.zeros(0, np.int64), np.zeros(0)
                for kind, slice_, blob in rows:
                    if kind == 0:
                        keys, gain = _pair_gains(blob, second, rates.value)
                    elif kind == 2:
                        yield row([slice_], [2], [blob])
                    else:
                        code, more, of, times = _unpack_pairs(blob)
                        at = np.searchsorted(keys, code)
                        at[at == len(keys)] = 0
                        worth = np.where(keys[at] == code, gain[at], 0.0) if len(keys) else np.zeros(len(code))
                        found = np.bincount(of, weights=np.repeat(worth, more + 1) * (times + 1))
                        n, x = sums.get(slice_, (0, np.zeros(0)))
                        if len(x) < len(found):
                            held += len(found) - len(x)
                            x = np.append(x, np.zeros(len(found) - len(x)))
                        x[: len(found)] += found
                        sums[slice_] = [n + len(of), x]
                if held > HELD_SUMS:
                    yield out()
                    sums, held = {}, 0
            if sums:
                yield out()

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in _by_shard(batches, "slice", "kind", "blob"):
                # what the slice holds comes last
                sums, met = np.zeros(0), 0
                ids = None
                for kind, blob in rows:
                    if kind == 1:
                        at, x, n = unpack(blob)
                        met += int(n[0])
                        if len(at):
                            sums = np.append(sums, np.zeros(max(0, int(at[-1]) + 1 - len(sums))))
                            sums[at] += x.view(np.float64)
                    else:
                        ids, total, n, events = unpack(blob)
                        total = total.view(np.float64).copy()
                        total[: len(sums)] += sums
                if ids is None or met != int(events[0]):
                    raise RuntimeError("a slice of texts came in parts that do not fit: its rows must come in the same order each time")
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.where(n > 0, constant + total / np.maximum(n, 1), 0.0))], ["text_id", "ratio"])

        table = self.shards.table.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("slice"), "blob")
        dealt = map_arrow(texts.select("text_id", "text"), deal, "shard int, kind int, slice long, blob binary").unionByName(table)
        met = map_arrow(dealt.repartition("shard").sortWithinPartitions("shard", "kind"), meet, "slice long, kind int, blob binary")
        found = map_arrow(met.repartition("slice").sortWithinPartitions("slice", "kind"), gather, "text_id long, ratio double")
        return found.groupBy("text_id").agg(F.max("ratio").alias("ratio"))


def _pair_gains(blob: bytes, second: int, rates: Rates) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, what each adds to its word's and its context's gain) of a table of pairs."""
    code, t0, o0, t1, o1 = _unpack_pairs(blob)
    t, o = (t0 + t1, o0 + o1) if second else (t0, o0)
    some = np.flatnonzero(t + o)
    code, t, o = code[some], t[some], o[some]
    v, w = code >> _WORD_BITS, code & (1 << _WORD_BITS) - 1
    pt, po = (x[w] for x in rates.words(second)[:2])
    ct, co, bt, bo = (x[v] for x in rates.contexts(second)[:4])
    et, eo = (np.maximum(x - WHOLE_DISCOUNT, 0) / np.maximum(c, 1) for x, c in ((t, ct), (o, co)))
    return code, np.log((et + bt * pt) / (eo + bo * po)) - np.log(bt / bo) - np.log(pt / po)


def numbered_model(shards: Shards, part: int) -> Numbered | None:
    """What gains(counts, *PARTS[part], WHOLE) has, for the pairs in their shards; None where a class has no words."""
    free = shards.free[part]
    return Numbered(shards, part, float(np.log(free[0] / free[1]))) if free else None


def _hashed_pairs(rows: DataFrame) -> DataFrame:
    """The same for any number of words: pairs go by their words' hashes."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            e = Events(part)
            at, code, kind = e.once(_pair_key(e.before, e.w), np.arange(len(e.w)))
            yield pa.RecordBatch.from_arrays([pa.array(e.before[at]), pa.array(e.w[at]), *e.counts(len(at), code, kind)], ["before", "word", *_KINDS])

    return map_arrow(rows, pairs, f"before long, word long, {_LONGS}").groupBy("before", "word").agg(*[F.sum(k).alias(k) for k in _KINDS])


def count(rows: DataFrame, most_words: int = NUMBERED_WORDS) -> Counts:
    """What rows (toxic, part, text) hold. Up to most_words words have numbers that are broadcast."""
    rows = rows.select("toxic", "part", "text")
    columns = (*_KINDS, "c0", "c1", *_AFTER)
    found = map_arrow(rows, _count_words, "word long, " + ", ".join(f"{k} long" for k in columns)).groupBy("word")
    found = materialise(found.agg(*[F.sum(k).alias(k) for k in columns]), "toxic-words", once=True)
    words_ = found.where("t0 + o0 + t1 + o1 > 0").select("word", *_KINDS, "c0", "c1")
    contexts = found.where(" + ".join(_AFTER) + " > 0").select(F.col("word").alias("before"), *[F.col(a).alias(k) for a, k in zip(_AFTER, _KINDS, strict=True)])
    if words_.limit(most_words + 1).count() <= most_words:
        shards = _shards(rows, found)
        return Counts(words_, shards.pairs(), contexts, shards)
    return Counts(words_, materialise(_hashed_pairs(rows), "toxic-pairs", once=True), contexts)


def _excess(own: Column, *least: Column) -> Column:
    """What a share has beyond its discount."""
    return F.greatest(own - F.greatest(*least), F.lit(0.0))


def gains(counts: Counts, toxic: str, ordinary: str, continued: str, by: Discounts = MARKED) -> tuple[DataFrame, float] | None:
    """((key, gain, docs), the constant) of the two models over counts; None where a class has no words. docs: documents that have the key."""
    alone = counts.words.select("word", F.expr(toxic).alias("t"), F.expr(ordinary).alias("o"), F.expr(continued).alias("n")).where("t + o > 0")
    n = alone.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    if not n["t"] or not n["o"]:
        return None
    small = min(n["t"], n["o"])
    t, o = F.col("t") / F.lit(float(n["t"])), F.col("o") / F.lit(float(n["o"]))
    # documents of a class that make the rate's unit: of the smaller class one, or of each class one
    unit = {c: n[c] / small if by.alike else 1.0 for c in "to"}
    ratio, rate = F.lit(by.ratio), [F.lit(by.words * unit[c] / n[c]) for c in "to"]
    lone = alone.select("word", "n", (F.col("t") + F.col("o")).alias("docs"), _excess(t, ratio * o, rate[0]).alias("et"), _excess(o, ratio * t, rate[1]).alias("eo"))
    s = lone.agg(F.sum("et").alias("t"), F.sum("eo").alias("o"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    bt, bo = 1 - s["t"], 1 - s["o"]
    constant = float(np.log(bt / bo))
    shared = (F.col("n") - F.lit(SHARED_DISCOUNT) + F.lit(SHARED_DISCOUNT * s["v"] / (s["v"] + 1))) / F.lit(float(s["n"]))
    lone = lone.select("word", "docs", (F.col("et") + F.lit(bt) * shared).alias("pt"), (F.col("eo") + F.lit(bo) * shared).alias("po"), (F.col("et") + F.col("eo") > 0).alias("own"))

    least = [F.lit(by.pairs * unit[c]) for c in "to"]
    some = counts.frequent(by.pairs).select("before", "word", F.expr(toxic).alias("t"), F.expr(ordinary).alias("o")).where((F.col("t") > least[0]) | (F.col("o") > least[1]))
    contexts = counts.contexts.select("before", F.expr(toxic).alias("ct"), F.expr(ordinary).alias("co"))
    if not by.ratio:
        # a class's excess rests on its own counts alone, so one sum by context tells what is freed
        kept = some.groupBy("before").agg(*[F.sum(F.greatest(F.col(c) - x, F.lit(0.0))).alias(f"k{c}") for c, x in zip("to", least, strict=True)])
        free = [F.when(F.col(f"c{c}") > 0, 1 - F.col(f"k{c}") / F.col(f"c{c}")).otherwise(1.0).alias(f"b{c}") for c in "to"]
        contexts = contexts.join(kept, "before").select("before", "ct", "co", *free)
    some = some.join(contexts, "before").join(lone.drop("docs", "own"), "word")
    qt, qo = (F.when(F.col(c) > 0, F.col(n_) / F.col(c)).otherwise(0.0) for n_, c in (("t", "ct"), ("o", "co")))
    rates = [F.when(F.col(c) > 0, x / F.col(c)).otherwise(1.0) for x, c in zip(least, ("ct", "co"), strict=True)]
    et, eo = _excess(qt, ratio * qo, rates[0], ratio * F.col("pt")), _excess(qo, ratio * qt, rates[1], ratio * F.col("po"))
    some = some.select("before", "word", "pt", "po", (F.col("t") + F.col("o")).alias("docs"), (F.col("ct") + F.col("co")).alias("after"), et.alias("et"), eo.alias("eo"), *([] if by.ratio else ["bt", "bo"])).where("et + eo > 0")
    if by.ratio:
        some = materialise(some, "toxic-pairs", once=True)
        freed = some.groupBy("before").agg(F.max("after").alias("after"), (1 - F.sum("et")).alias("bt"), (1 - F.sum("eo")).alias("bo"))
        some = some.join(freed.drop("after"), "before")
    else:
        freed = contexts.select("before", (F.col("ct") + F.col("co")).alias("after"), "bt", "bo")
    context = F.log(F.col("bt") / F.col("bo"))
    both = F.log((F.col("et") + F.col("bt") * F.col("pt")) / (F.col("eo") + F.col("bo") * F.col("po")))
    out = lone.where("own").select(F.col("word").alias("key"), (F.log(F.col("pt") / F.col("po")) - F.lit(constant)).alias("gain"), "docs")
    out = out.unionByName(freed.select(F.col("before").bitwiseXOR(F.lit(_CONTEXT)).alias("key"), context.alias("gain"), F.col("after").alias("docs")))
    out = out.unionByName(some.select(_pair_column().alias("key"), (both - context - F.log(F.col("pt") / F.col("po"))).alias("gain"), "docs"))
    return materialise(out, "toxic-gains", once=True), constant


def _keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all words, contexts and pairs, the texts that they stand in, and the number of words of each text."""
    w, before, of = _words(texts)
    return np.concatenate([w, before ^ _CONTEXT, _pair_key(before, w)]), np.tile(of, 3), np.bincount(of, minlength=len(texts))


def _adder(table: DataFrame) -> Callable[[np.ndarray, np.ndarray, int], np.ndarray]:
    """A function that sums the gains of a table (broadcast) by text."""
    got = table.toArrow()
    order = np.argsort(got["key"].to_numpy())
    known = table.sparkSession.sparkContext.broadcast((got["key"].to_numpy()[order], got["gain"].to_numpy()[order]))

    def add(k: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
        keys, gain = known.value
        if not len(keys):
            return np.zeros(rows)
        few = np.zeros(1 << 22, bool)
        few[(keys.view(np.uint64) >> np.uint64(42)).astype(np.int64)] = True
        maybe = np.flatnonzero(few[(k.view(np.uint64) >> np.uint64(42)).astype(np.int64)])
        at = np.searchsorted(keys, k[maybe])
        at[at == len(keys)] = 0
        hit = keys[at] == k[maybe]
        return np.bincount(of[maybe[hit]], weights=gain[at[hit]], minlength=rows)

    return add


def ratios(docs: DataFrame, table: DataFrame, constant: float, keep: tuple[str, ...] = (), most: int = TABLE_ROWS) -> DataFrame:
    """docs (id, text, ...) -> (id, *keep, ratio): difference of the log-likelihoods per word (0 without words)."""
    cols = ["id", *keep]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in cols)
    if table.limit(most + 1).count() > most:
        return _joined(docs, table, constant, cols, schema, most)
    add = _adder(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            k, of, n = _keys(part.column("text"))
            total = add(k, of, part.num_rows)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in cols), pa.array(np.where(n > 0, constant + total / np.maximum(n, 1), 0.0))], [*cols, "ratio"])

    return map_arrow(docs.select(*cols, "text"), run, f"{schema}, ratio double")


def _split(table: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The keys of the most documents, `most` at most, and the others."""
    if "docs" not in table.columns:
        return table.where("false"), table
    sizes = table.groupBy(F.floor(F.log2("docs") * 4).alias("size")).count().toPandas().sort_values("size", ascending=False)
    fit = sizes[sizes["count"].cumsum() <= most]
    if not len(fit):
        return table.where("false"), table
    often = F.floor(F.log2("docs") * 4) >= int(fit["size"].min())
    return table.where(often), table.where(~often)


def _joined(docs: DataFrame, table: DataFrame, constant: float, cols: list[str], schema: str, most: int) -> DataFrame:
    """ratios() for a table of any size: its commonest keys are broadcast, keys that pass a sieve of the others meet them in a shuffle."""
    rows = numbered(docs.select(*cols, "text"), "toxic-rows")
    common, table = _split(table, most)
    add = _adder(common)
    bits = docs.sparkSession.sparkContext.broadcast(sieve(table, "key", SIEVE_BITS))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            k, of, _ = _keys(part.column("text"))
            some = np.flatnonzero(in_sieve(bits.value, k, SIEVE_BITS))
            code, each = pd.factorize(k[some])
            cell, times = np.unique(code * part.num_rows + of[some], return_counts=True)
            yield pa.RecordBatch.from_arrays([part.column("_row").take(pa.array(cell % part.num_rows)), pa.array(each[cell // part.num_rows]), pa.array(times.astype(np.int32))], ["_row", "key", "times"])

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            k, of, n = _keys(part.column("text"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [*cols, "_row"]), pa.array(n), pa.array(add(k, of, part.num_rows))], [*cols, "_row", "n", "common"])

    total = map_arrow(rows.select("_row", "text"), found, "_row long, key long, times int").join(table, "key").groupBy("_row").agg(F.sum(F.col("times") * F.col("gain")).alias("total"))
    sized = map_arrow(rows, size, f"{schema}, _row long, n long, common double").join(total, "_row", "left")
    return sized.select(*cols, F.when(F.col("n") > 0, F.lit(constant) + (F.col("common") + F.coalesce("total", F.lit(0.0))) / F.col("n")).otherwise(0.0).alias("ratio"))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression of y on the columns of x, with a little ridge, by Newton's method."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    a = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, ridge = np.zeros(a.shape[1]), np.diag([*RIDGE, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


def _mixed(marked: tuple[DataFrame, float], whole: tuple[DataFrame, float], weights: np.ndarray) -> tuple[DataFrame, float]:
    """One table with the weighted sums of both; every key of the first is one of the second."""
    a, b = float(weights[0]), float(weights[1])
    few = marked[0].select("key", F.col("gain").alias("_marked"))
    if few.limit(TABLE_ROWS + 1).count() <= TABLE_ROWS:
        few = F.broadcast(few)
    gain = F.lit(b) * F.col("gain") + F.lit(a) * F.coalesce("_marked", F.lit(0.0))
    return whole[0].join(few, "key", "left").select("key", gain.alias("gain"), "docs"), a * marked[1] + b * whole[1]


@dataclass(frozen=True)
class Model:
    #: (gains, constant) of the marked model
    marked: tuple[DataFrame, float] | None
    #: the whole one; gains where words are too many to be numbered
    whole: Numbered | tuple[DataFrame, float] | None
    #: of both in a text's logit
    weights: tuple[float, float]
    offset: float
    counts: Counts | None = None

    def table(self) -> tuple[DataFrame, float]:
        whole = gains(self.counts, *PARTS[1], WHOLE) if isinstance(self.whole, Numbered) else self.whole
        return _mixed(self.marked, whole, np.array(self.weights))

    @property
    def gains(self) -> DataFrame | None:
        """(key long, gain double): what words, contexts and pairs add to the constant for each of their places, in one table; made when asked for."""
        return self.table()[0] if self.marked else None


def _text_id() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _both(docs: DataFrame, marked: tuple[DataFrame, float], whole: Numbered, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (id, text, ...) -> (id, *keep, marked, whole): the ratios of both models. Equal texts are judged once, by a hash."""
    docs = docs.withColumn("text_id", _text_id())
    first = ratios(docs, *marked, keep=("text_id", *keep)).withColumnRenamed("ratio", "marked")
    second = whole.ratios(docs).withColumnRenamed("ratio", "whole")
    return first.join(second, "text_id", "left").select("id", *keep, "marked", "whole")


def train(rows: DataFrame) -> Model:
    """rows: (id, text, toxic). A quarter by hash of the id is held back for the curve, then counted as well."""
    rows = rows.withColumn("part", F.when(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(4)) == 0, 1).otherwise(0))
    counts = count(rows)
    marked = gains(counts, *PARTS[1])
    if marked is None:
        return Model(None, None, (0.0, 0.0), 0.0)

    def whole(part: int) -> Numbered | tuple[DataFrame, float]:
        return numbered_model(counts.shards, part) if counts.shards else gains(counts, *PARTS[part], WHOLE)

    first = gains(counts, *PARTS[0])
    weights, offset = np.array([CURVE[0], 0.0]), CURVE[1]
    if first is not None:
        back = rows.where("part = 1").withColumn("_h", F.xxhash64(F.lit("curve"), F.col("id").cast("string")))
        total = back.count()
        if total > CURVE_ROWS:
            # a bounded sample by hash, for three numbers
            back = back.where(F.pmod("_h", F.lit(1 << 30)) < int((1 << 30) * CURVE_ROWS / total))
        back = back.select("id", "text", "toxic")
        if counts.shards:
            held = _both(back, first, whole(0), keep=("toxic",))
        else:
            held = ratios(back.select("id", "text", F.col("text").alias("_text"), "toxic"), *first, keep=("_text", "toxic"))
            held = held.select("id", F.col("_text").alias("text"), "toxic", F.col("ratio").alias("marked"))
            held = ratios(held, *whole(0), keep=("toxic", "marked")).withColumnRenamed("ratio", "whole")
        held = materialise(held.select("marked", "whole", "toxic"), "toxic-held", once=True).toPandas()
        y = (held["toxic"].to_numpy() > 0).astype(float)
        if len(y) and y.min() < y.max():
            weights, offset = _curve(held[["marked", "whole"]].to_numpy(), y)
    return Model(marked, whole(1), (float(weights[0]), float(weights[1])), offset, counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score."""
    if model.marked is None:
        return docs.select(id_col, F.lit(0.0).alias("score"))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if isinstance(model.whole, Numbered):
        a, b = model.weights
        found = _both(docs, model.marked, model.whole).select("id", (F.lit(a) * F.col("marked") + F.lit(b) * F.col("whole")).alias("ratio"))
    else:
        found = ratios(docs, *model.table())
    logit = F.col("ratio") + F.lit(model.offset)
    return found.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-logit))).alias("score"))


__all__ = ["Counts", "Discounts", "Model", "Numbered", "Shards", "count", "gains", "labelled", "numbered_model", "ratios", "score", "train"]
