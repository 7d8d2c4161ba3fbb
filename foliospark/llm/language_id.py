"""Language ID by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces
(forward algorithm); a text's is the product over its words.  The piece
probabilities are expected counts: every training word's segmentations are
weighed under one prior over the vocabulary (1 / (rank + 10)), forward and
backward, and each piece gets its posterior share once per occurrence of the
word in a text of the language.  All training texts count in full; what is
collected is one number per language and piece, bounded by the vocabulary.

Words are maximal runs of letters, lower-cased, with the model's space mark in
front.  A letter without a piece costs a fixed probability in each language
(instead of the vocabulary's byte pieces, which say nothing of letters).
Words repeat, so each slice of a partition works on its distinct words, all
side by side.  A null text or one without a letter is `und` with score 0; with
no training rows everything is `und`.  Equal scores: the first language by name.
Rows that repeat an id, or have none, are each judged by their own text, and an
empty table gives no rows; only id, text and (in training) language are read.
The table of probabilities is languages x pieces: languages are taken to be few
(hundreds at most), since each is a column of every word's forward sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import char_hashes, map_arrow, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: longest piece of letters that a vocabulary may have; one with longer pieces is refused, none are left out
PIECE_CHARS = 16
UNKNOWN = 1e-7
#: weight of the prior in each language's distribution, in pieces
PRIOR = 50.0
SLICE = 2 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_C = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
_BITS = np.uint64(64 - 20)


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        #: characters of the longest piece that a word can hold: letters, with or without the space mark in front
        self.depth = max(len(p) for p in self.pieces if p.removeprefix("▁").isalpha())
        if self.depth > PIECE_CHARS:
            raise ValueError(f"pieces of up to {self.depth} characters")
        n = len(self.pieces)
        self.key = np.zeros(n + 1, np.uint64)
        for i, p in enumerate(self.pieces):
            h = 0
            for ch in p:
                h = (h * int(_M) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
            self.key[i] = h
        self.table = [np.full(1 << 20, n, np.int32) for _ in _C]
        self.more: dict[int, int] = {}
        rest = np.arange(n)
        for t, c in zip(self.table, _C, strict=True):
            slot = ((self.key[rest] * c) >> _BITS).astype(np.int64)
            t[slot[::-1]] = rest[::-1]
            rest = rest[t[slot] != rest]
        if len(rest):
            raise ValueError("two pieces share both cells")
        prior = 1.0 / (np.arange(n) + 10.0)
        self.prior = prior / prior.sum()
        cps = range(0x110000)
        self.letter = np.fromiter((chr(i).isalpha() for i in cps), bool, 0x110000)
        low = np.arange(0x110000, dtype=np.uint32)
        for i in np.flatnonzero(self.letter).tolist():
            x = chr(i).lower()
            if len(x) == 1:
                low[i] = ord(x)
        self.low = low

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or len(pieces)."""
        n = len(self.pieces)
        got = self.table[0][((h * _C[0]) >> _BITS).astype(np.int64)]
        other = (got != n) & (self.key[got] != h)
        if other.any():
            x = h[other]
            second = self.table[1][((x * _C[1]) >> _BITS).astype(np.int64)]
            got[other] = np.where(self.key[second] == x, second, n)
        return got


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Words:
    """Distinct words of some texts: their characters, longest first, and which text has which."""

    def __init__(self, texts: list[str], v: Vocabulary):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        c = v.low[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        on = v.letter[c] if len(c) else np.zeros(0, bool)
        head = on.copy()
        head[1:] &= ~on[:-1]
        at = np.cumsum(lens) - lens
        inner = at[(lens > 0) & (at < len(c))]
        head[inner] = on[inner]
        stop = np.zeros(len(c), bool)
        if len(c):
            stop[:-1] = head[1:] | ~on[1:]
            stop[-1] = True
            stop &= on
        s, e = np.flatnonzero(head), np.flatnonzero(stop) + 1
        self.text = np.searchsorted(at, s, side="right") - 1
        if len(s) == 0:
            self.of, self.flat, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        n = e - s
        of, _ = pd.factorize(char_hashes(c, s, n))
        rep = np.empty(int(of.max()) + 1, np.int64)
        rep[of[::-1]] = np.arange(len(of) - 1, -1, -1)
        by = np.argsort(-n[rep], kind="stable")
        new = np.empty(len(by), np.int64)
        new[by] = np.arange(len(by))
        self.of = new[of]
        rep = rep[by]
        size = n[rep] + 1
        self.start = np.cumsum(size) - size
        self.flat = np.empty(int(size.sum()), np.uint32)
        self.flat[self.start] = 0x2581
        rest = np.ones(len(self.flat), bool)
        rest[self.start] = False
        k = n[rep]
        self.flat[rest] = c[np.repeat(s[rep] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
        self.size = size

    def steps(self, v: Vocabulary) -> Iterator[tuple[int, int, list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]]:
        """For each end place j: (j, words that reach it, [(length, words, pieces)], words without a piece for the letter)."""
        m, none = len(self.size), len(v.pieces)
        h = np.zeros((v.depth, m), np.uint64)
        longest = int(self.size[0]) if m else 0
        reach = np.searchsorted(-self.size, -np.arange(1, longest + 1), side="right")
        for j in range(longest):
            a = int(reach[j])
            c = self.flat[self.start[:a] + j].astype(np.uint64) + np.uint64(1)
            n = min(v.depth, j + 1)
            for k in range(n - 1, 0, -1):
                np.multiply(h[k - 1, :a], _M, out=h[k, :a])
                h[k, :a] += c
            h[0, :a] = c
            edges = []
            lone = np.zeros(0, np.int64)
            for k in range(n):
                got = v.find(h[k, :a])
                rows = np.flatnonzero(got != none)
                if k == 0 and len(rows) < a:
                    lone = np.flatnonzero(got == none)
                if len(rows):
                    edges.append((k + 1, rows, got[rows]))
            yield j, a, edges, lone

    def likelihoods(self, v: Vocabulary, p: np.ndarray) -> np.ndarray:
        """log probability of every word (rows) in every language (columns of p)."""
        m, langs, deep = len(self.size), p.shape[1], v.depth + 1
        ring = np.zeros((deep, m, langs))
        ring[0] = 1.0
        scale, out = np.zeros(m), np.zeros((m, langs))
        for j, a, edges, lone in self.steps(v):
            new = ring[(j + 1) % deep]
            new[:a] = 0
            for k, rows, got in edges:
                new[rows] += ring[(j + 1 - k) % deep][rows] * p[got]
            if len(lone):
                new[lone] += ring[j % deep][lone] * UNKNOWN
            low = np.flatnonzero(new[:a].max(axis=1) < 1e-100)
            if len(low):
                ring[:, low] *= 1e100
                scale[low] -= 100 * np.log(10.0)
            end = np.flatnonzero(self.size[:a] == j + 1)
            out[end] = np.log(np.maximum(new[end], 1e-300)) + scale[end, None]
        return out

    def expected(self, v: Vocabulary, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts under the prior, (pieces, languages), of words with weight (words, languages)."""
        m = len(self.size)
        cells = int(self.size.sum()) + m
        base = self.start + np.arange(m)  # a word has one more place than characters
        fore, back, lift = np.zeros(cells), np.zeros(cells), np.zeros(cells)
        fore[base] = 1.0
        kept = []
        for j, a, edges, lone in self.steps(v):
            at = base[:a] + j + 1
            for k, rows, got in edges:
                frm = at[rows] - k
                # values stand with their own scale: lift is its log
                fore[at[rows]] += fore[frm] * v.prior[got] * np.exp(lift[frm] - lift[at[rows] - 1])
            if len(lone):
                fore[at[lone]] += fore[at[lone] - 1] * UNKNOWN
            f = np.maximum(fore[at], 1e-300)
            lift[at] = lift[at - 1] + np.log(f)
            fore[at] = 1.0
            kept.append((at, edges, lone))
        back[base + self.size] = 1.0
        sums = np.zeros((len(v.pieces), weight.shape[1]))
        # fore is 1 everywhere now, so exp(lift) is the forward value; back is scaled by the forward value of its place
        for at, edges, lone in reversed(kept):
            here = back[at]
            for k, rows, got in edges:
                frm = at[rows] - k
                share = v.prior[got] * np.exp(lift[frm] - lift[at[rows]]) * here[rows]
                back[frm] += share
                for lang in range(weight.shape[1]):
                    w = weight[rows, lang]
                    if w.any():
                        sums[:, lang] += np.bincount(got, weights=share * w, minlength=len(v.pieces))
            if len(lone):
                back[at[lone] - 1] += UNKNOWN * np.exp(lift[at[lone] - 1] - lift[at[lone]]) * here[lone]
        return sums


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", model: str = MODEL) -> tuple[list[str], np.ndarray]:
    """Languages by name, and piece probabilities (pieces, languages), from all rows with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches, "text", SLICE):
            w = Words(part.column("text").fill_null("").to_pylist(), v)
            of, names = pd.factorize(part.column("lang").to_pandas())
            if not len(w.of):
                continue
            weight = np.bincount(w.of * len(names) + of[w.text], minlength=len(w.size) * len(names)).reshape(-1, len(names)).astype(float)
            for i, col in enumerate(w.expected(v, weight).T):
                sums[names[i]] = sums.get(names[i], 0) + col
        for name, col in sums.items():
            some = np.flatnonzero(col > 0)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(col[some])], ["lang", "piece", "n"])

    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = map_arrow(rows, count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    v = vocabulary(model)
    langs = sorted(counts["lang"].unique())
    n = np.zeros((len(v.pieces), len(langs)))
    n[counts["piece"].to_numpy(), np.searchsorted(langs, counts["lang"].to_numpy(str)) if langs else []] = counts["n"].to_numpy()
    return langs, (n + PRIOR * v.prior[:, None]) / (n.sum(axis=0) + PRIOR)


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per document: id, lang_pred, score (the probability of the language, all equally likely before)."""
    known = docs.sparkSession.sparkContext.broadcast((langs, p))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        langs, p = known.value
        for part in slices(batches, "text", SLICE):
            w = Words(part.column("text").fill_null("").to_pylist(), v)
            rows = part.num_rows
            names = np.full(rows, "und", object)
            best = np.zeros(rows)
            if langs and len(w.of):
                each = w.likelihoods(v, p)
                total = np.column_stack([np.bincount(w.text, weights=each[w.of, i], minlength=rows) for i in range(len(langs))])
                has = np.bincount(w.text, minlength=rows) > 0
                top = total.argmax(axis=1)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                names[has] = np.array(langs, object)[top[has]]
                best[has] = (1 / odds.sum(axis=1))[has]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(best)], ["id", "lang_pred", "score"])

    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), score, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
