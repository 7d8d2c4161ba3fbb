"""SentencePiece encoding and decoding by suffix-array matching.

For a batch: the distinct units (spaces and the characters up to the next
space; no piece of a split-by-space model reaches over one) are joined to one
text, whose suffixes are sorted by as many characters as the longest piece
has.  Every piece is found by binary search as one range of the suffix array;
the ranges are the edges (start, end, piece).  Edges are sorted by the position
of their end and relaxed in that order, all units side by side.

Relaxing follows the model's kind (byte-pair merges): the merges of a prefix
end in one certain piece, and an edge may follow it exactly if no merge across
the joint would have come before those inside the two pieces.  That is decided
per pair of pieces by undoing their merges from the last to the first, and
kept in a table.  So the ids are those of the library's own encoder, without
running it.

Characters without a piece become bytes (byte fallback).  A literal U+2581 in
a text is written as bytes as well, so that decode(encode(text)) is the text
for every text (the library turns it into a space).  Empty and null texts have
no ids.  No limit on the length of texts or units.  Rows that repeat an id, or
have none, each get their own ids; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import char_hashes, map_arrow, mix, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x110000
#: a vocabulary's pieces may have this many characters at most (the sort depth)
DEPTH = 16
CACHE_BITS = 21
#: characters of an index, about; a longer unit gets its own
INDEX_CHARS = 400_000
#: text of a batch; larger batches have fewer distinct units in proportion, but need some 80 bytes of memory a byte
SLICE = 2 << 20


class Pieces:
    """The vocabulary in the order of its merges, and the pair table."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_at = np.full(256, -1, np.int64)
        table: dict[str, tuple[int, float]] = {}
        self.decoded: list[bytes] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_at[int(p[1:-1], 16)] = i
                self.decoded.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.decoded.append(b"")
            else:
                table[p] = (i, sp.get_score(i))
                self.decoded.append(p.replace("▁", " ").encode())
        if (self.bytes_at < 0).any():
            raise ValueError("the model needs byte fallback")
        if any("▁" in p.lstrip("▁") for p in table) or max(map(len, table)) > DEPTH:
            raise ValueError("pieces that reach over a space, or are too long")
        # order: single characters, then merges as they are made
        base = sorted(p for p in table if len(p) == 1)
        merged = sorted((p for p in table if len(p) > 1), key=lambda p: -table[p][1])
        self.order = base + merged
        rank = {p: k for k, p in enumerate(self.order)}
        self.id_of = np.array([table[p][0] for p in self.order], np.int64)
        self.n_base = len(base)
        left, right = np.arange(len(rank)), np.arange(len(rank))
        usable = np.ones(len(rank), bool)
        for p in merged:
            parts = list(p)
            while len(parts) > 1:
                k, j = min(((rank.get(a + b, len(rank)), j) for j, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(len(rank), 0))
                if k == len(rank):
                    break
                if len(parts) == 2:
                    left[rank[p]], right[rank[p]] = rank.get(parts[0], -1), rank.get(parts[1], -1)
                parts[j : j + 2] = [parts[j] + parts[j + 1]]
            usable[rank[p]] = len(parts) == 1 and left[rank[p]] >= 0 and right[rank[p]] >= 0 and left[rank[p]] != rank[p]
        self.left, self.right = left, right
        pairs = {}
        for p in merged:
            for j in range(1, len(p)):
                a, b = rank.get(p[:j]), rank.get(p[j:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank[p]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        code = lambda p: [SPACE if c == "▁" else ord(c) for c in p]
        letters = sorted({c for p in table for c in code(p)})
        #: characters as 16-bit letters: 0 ends a unit, 1 is any character of no piece
        self.letter = np.ones(SPACE + 1, np.uint16)
        self.letter[letters] = np.arange(2, len(letters) + 2)
        self.single = np.zeros(SPACE + 1, bool)
        self.single[[code(p)[0] for p in base]] = True
        self.usable = np.flatnonzero(usable)
        self.size = np.array([len(p) for p in self.order])[self.usable]
        self.rows = np.zeros((len(self.usable), DEPTH), np.uint16)
        for k, r in enumerate(self.usable):
            self.rows[k, : self.size[k]] = self.letter[code(self.order[r])]
        lens = np.array([len(x) for x in self.decoded])
        self.dec_at = np.concatenate(([0], np.cumsum(lens)))
        self.dec = np.frombuffer(b"".join(self.decoded), np.uint8)
        self.tags = np.full(1 << CACHE_BITS, -1, np.int64)
        self.vals = np.zeros(1 << CACHE_BITS, bool)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b may follow a (both in merge order), from the table where it is known."""
        key = a << 32 | b
        at = (mix(key.astype(np.uint64)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        out = self.vals[at]
        new = np.flatnonzero(self.tags[at] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            ok = self._follows(keys >> 32, keys & 0xFFFFFFFF)[back]
            out[new] = ok
            # one pair per cell: the last written of tag and value must be the same pair
            cells, first = np.unique(at[new], return_index=True)
            self.tags[cells], self.vals[cells] = key[new][first], ok[first]
        return out

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            key = a << 32 | b
            i = np.searchsorted(self.pair_keys, key)
            i[i == len(self.pair_keys)] = 0
            broken = (self.pair_keys[i] == key) & (self.pair_to[i] < limit)
            out[live[broken]] = False
            # undo the later of the two merges; a single character can't be undone
            undo_a = (a > b) & (a >= self.n_base) | (b < self.n_base)
            done = (a < self.n_base) & (b < self.n_base)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            go = ~broken & ~done
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and where each text's ids begin (and the last end)."""
        if len(texts) == 0:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.where(chars == 32, SPACE, chars).astype(np.int32)
        at = np.concatenate(([0], np.cumsum(lens)))
        full = lens > 0
        c = np.insert(chars, at[:-1][full], SPACE)  # the space that the model puts first
        if not len(c):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        begin = at[:-1] + np.cumsum(full) - full
        head = c == SPACE
        head[1:] &= c[:-1] != SPACE
        head[begin[full]] = True
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, len(c)))
        del chars, head
        of, _ = pd.factorize(char_hashes(c, start, size))
        rep = np.empty(int(of.max()) + 1, np.int64)
        rep[of[::-1]] = np.arange(len(of) - 1, -1, -1)
        group = np.cumsum(size[rep] + 1) // INDEX_CHARS
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        parts = [self._units(c, start[rep[x:y]], size[rep[x:y]]) for x, y in zip(cuts, cuts[1:], strict=False)]
        ids = np.concatenate([x for x, _ in parts])
        n_tok = np.concatenate([x for _, x in parts])
        tok_at = np.concatenate(([0], np.cumsum(n_tok)))
        count = n_tok[of]
        cum = np.concatenate(([0], np.cumsum(count)))
        flat = ids[np.repeat(tok_at[:-1][of] - cum[:-1], count) + np.arange(cum[-1])]
        unit_at = np.searchsorted(start, np.append(begin, len(c)))
        return flat.astype(np.int32), cum[unit_at]

    def _units(self, c: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the units c[start:start+size], and how many each has."""
        n = size + 1
        begin = np.cumsum(n) - n
        total = int(n.sum())
        offset = np.arange(total) - np.repeat(begin, n)  # in the unit; its last place is the separator
        text = c[np.minimum(np.repeat(start, n) + offset, len(c) - 1)]
        inside = np.ones(total, bool)
        inside[begin + size] = False
        letters = np.where(inside, self.letter[text], 0)
        index = SuffixIndex(letters, offset, n)
        some, low, high = index.search(self.rows, self.size)
        # places of an index and pieces fit 32 bits, unless one unit alone is longer than that
        small = np.int32 if total < 1 << 31 else np.int64
        order, used, length = index.order.astype(small), self.usable[some].astype(np.int32), self.size[some].astype(small)
        del index
        found = high - low
        cum = np.cumsum(found) - found
        edges = int(found.sum())
        pos = order[np.repeat(low - cum, found) + np.arange(edges)]
        del order
        end = pos + np.repeat(length, found)
        piece = np.repeat(used, found)
        lone = np.flatnonzero(inside & ~self.single[text]).astype(small)
        pos, end, piece = np.concatenate((pos, lone)), np.concatenate((end, lone + 1)), np.concatenate((piece, np.full(len(lone), -1, np.int32)))
        by = offset[end] << 32
        by |= np.arange(len(by))
        by.sort()
        cuts = np.searchsorted(by, np.arange(1, int(size.max()) + 2) << 32)
        by &= 0xFFFFFFFF
        pos, end, piece = pos[by], end[by], piece[by]
        del by
        last = np.full(total, -2, np.int32)  # the piece before each place; -1: bytes, -2: the unit's begin
        back = np.zeros(total, np.int64)
        for i in range(len(cuts) - 1):
            s = slice(cuts[i], cuts[i + 1])
            p, q, e = pos[s], piece[s], end[s]
            a = last[p]
            ask = (a >= 0) & (q >= 0)
            ok = ~ask
            ok[ask] = self.follows(a[ask].astype(np.int64), q[ask].astype(np.int64))
            last[e[ok]] = q[ok]
            back[e[ok]] = p[ok]
        mark = np.zeros(total, bool)
        at, stop = begin + size, begin.copy()
        while len(at):
            mark[at] = True
            at = back[at]
            more = at > stop
            at, stop = at[more], stop[more]
        tok_end = np.flatnonzero(mark)
        got = last[tok_end]
        char = text[np.maximum(tok_end - 1, 0)]
        width = np.where(got >= 0, 1, 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF))
        out_at = np.cumsum(width) - width
        ids = np.zeros(int(width.sum()), np.int64)
        ids[out_at[got >= 0]] = self.id_of[got[got >= 0]]
        raw = np.flatnonzero(got < 0)
        for k in range(1, 5):
            r = raw[width[raw] == k]
            x = char[r].astype(np.int64)
            for j in range(k):
                if k == 1:
                    b = x
                elif j == 0:
                    b = (0xF00 >> k & 0xFF) | x >> 6 * (k - 1)
                else:
                    b = 0x80 | x >> 6 * (k - 1 - j) & 0x3F
                ids[out_at[r] + j] = self.bytes_at[b]
        unit = np.searchsorted(begin, tok_end, side="right") - 1
        per = np.bincount(unit, weights=width, minlength=len(begin)).astype(np.int64)
        return ids, per

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of id lists; bytes that are no UTF-8 become U+FFFD."""
        n = self.dec_at[ids + 1] - self.dec_at[ids]
        cum = np.concatenate(([0], np.cumsum(n)))
        data = self.dec[np.repeat(self.dec_at[ids] - cum[:-1], n) + np.arange(cum[-1])].tobytes()
        ends = cum[at].tolist()
        texts = [data[x:y].decode("utf-8", "replace") for x, y in zip(ends, ends[1:], strict=False)]
        return [t[1:] if t[:1] == " " else t for t in texts]


class SuffixIndex:
    """Suffix array of joined units, sorted by DEPTH letters; letter 0 ends a unit and what follows it doesn't count."""

    def __init__(self, letters: np.ndarray, offset: np.ndarray, n: np.ndarray):
        total = len(letters)
        seen = np.bincount(letters, minlength=2) > 0
        seen[:2] = True
        self.small = np.where(seen, np.cumsum(seen) - 1, -1)
        #: bits of a letter; all ones is no letter
        self.bits = (int(seen.sum()) + 1).bit_length()
        left = np.repeat(n, n) - 1 - offset  # letters up to the unit's end
        place = max(total.bit_length(), 1)
        self.per = max(1, min(DEPTH, (63 - place) // self.bits))
        x = np.zeros(total + DEPTH, np.int64)
        x[:total] = self.small[letters]
        first = x[:total].copy()
        for j in range(1, self.per):
            first = first << self.bits | np.where(left > j, x[j : j + total], 0)
        self.first, width = first, self.per
        key = np.sort(first << place | np.arange(total))
        self.order = key & ((1 << place) - 1)
        group = key >> place
        while width < DEPTH:
            rank = np.empty(total, np.int64)
            rank[self.order] = np.concatenate(([0], np.cumsum(group[1:] != group[:-1])))
            after = np.zeros(total, np.int64)
            more = np.flatnonzero(left > width)
            after[more] = rank[more + width] + 1
            if 3 * place <= 63:  # after is at most total, which has place bits
                key = np.sort(rank << 2 * place | after << place | np.arange(total))
                self.order, group = key & ((1 << place) - 1), key >> place
            else:
                self.order = np.lexsort((after, rank))
                group = rank[self.order] * (total + 1) + after[self.order]
            width *= 2
        self.left, self.total = left, total

    def _keys(self, rows: np.ndarray, fill: int) -> list[np.ndarray]:
        out = []
        for j in range(0, DEPTH, self.per):
            k = np.zeros(len(rows), np.int64)
            for i in range(j, j + self.per):
                k = k << self.bits | (rows[:, i] if i < DEPTH else fill)
            out.append(k)
        return out

    def search(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By binary search: which pieces have all their letters here, and the range of the suffix array for each."""
        of = np.full(max(int(rows.max()) + 1, len(self.small)), -1)
        of[: len(self.small)] = self.small
        mapped = of[rows]
        pad = np.arange(DEPTH) >= size[:, None]
        some = np.flatnonzero(((mapped > 0) | pad).all(axis=1))
        mapped, pad = mapped[some], pad[some]
        bounds = []
        for fill, upper in ((0, False), ((1 << self.bits) - 1, True)):
            want = self._keys(np.where(pad, fill, mapped), fill)
            lo, hi = np.zeros(len(some), np.int64), np.full(len(some), self.total)
            for _ in range(self.total.bit_length()):
                mid = (lo + hi) >> 1
                at = self.order[np.minimum(mid, self.total - 1)]
                rest = self.left[at]
                less, same = np.zeros(len(some), bool), np.ones(len(some), bool)
                for j, w in enumerate(want):
                    k = np.where(rest > j * self.per, self.first[np.minimum(at + j * self.per, self.total - 1)], 0)
                    less |= same & (k < w)
                    same &= k == w
                less = (less | same if upper else less) & (lo < hi)
                lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.where(lo < hi, mid, hi))
            bounds.append(lo)
        return some, bounds[0], np.maximum(bounds[0], bounds[1])


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, slice_bytes: int = SLICE, decoded: bool = False) -> DataFrame:
    """One row per document: id, ids array<int>; with decoded also the text that decoding the ids gives back."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for part in slices(batches, "text", slice_bytes):
            ids, at = own.encode(part.column("text").fill_null("").to_pylist())
            cols = [part.column("id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
            if decoded:
                cols.append(pa.array(own.decode(ids, at), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["id", "ids", "decoded"][: 2 + decoded]
    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, ids array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def decoder(model: str = MODEL):
    """A function of a column of ids that gives the text."""

    @F.pandas_udf("string")
    def decode(ids):
        own = pieces(model)
        lists = [np.asarray(x, np.int64) if x is not None else np.zeros(0, np.int64) for x in ids]
        at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        return pd.Series(own.decode(np.concatenate(lists) if lists else np.zeros(0, np.int64), at), index=ids.index)

    return decode


def decode(ids: Column, model: str = MODEL) -> Column:
    return decoder(model)(ids)
