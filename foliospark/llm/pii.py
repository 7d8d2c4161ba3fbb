"""PII: identifiers in plain and in disguised form, as spans of the source text.

Base kinds, leftmost and non-overlapping per kind (a match that fails its test
is dropped and not tried again): email, ip (four parts to 255), card (12 to 19
digits with a valid check digit), phone (a plus and 9 to 15 digits).

Disguises are undone by transducers that keep, for every character they write,
the source span it came from: (1) look-alikes and full-width forms become
ASCII, invisible characters vanish; (2) bracketed at and dot, the words in an
address that has both (or an @), and an at word before the name of a host
(`bob at example.com`) become @ and dots; (3) runs of LONG_RUN and more spelled
digits become digits, with plus and dot words in between; (4) so do shorter
runs beside figures, a plus or another such run, and dot words between figures.
The base detectors run over the result of (1) to (3), then over that of (4); a
match that holds a changed character is mapped back and added, unless it
touches a span of its kind found before.  9 to 15 spelled digits in a row, in
words alone, are a phone number even without a plus, unless they are part of
another span.  Runs are beside what spaces or signs of numbers (and a dot word)
part them from, however many.  The word plus counts only before a spelled digit.

Offsets are code points of the source, end exclusive.  Null texts are empty, an
empty table gives no rows, rows that repeat an id each give theirs, other columns
are never looked at.
Every scan is linear in the text: addresses are found from each @ outwards and
addresses of parts are cut from whole digit chains, so long runs cost no more
than their length.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

KINDS = ("email", "ip", "card", "phone")

# Look-alikes of ASCII letters in other scripts (besides those that Unicode itself maps to ASCII).
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "٠": "0", "١": "1",
    "٢": "2", "٣": "3", "٤": "4", "٥": "5", "٦": "6", "٧": "7", "٨": "8", "٩": "9", " ": " ", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
# Digit words of four languages.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def _single() -> dict[int, str | None]:
    """Characters that become one ASCII character (or nothing)."""
    table: dict[int, str | None] = {ord(k): v for k, v in LOOKALIKES.items()}
    for lo, hi in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x2474), (0x24B6, 0x24EA), (0x2080, 0x208A), (0x1F130, 0x1F14A)):
        for i in range(lo, hi):
            x = unicodedata.normalize("NFKC", chr(i))
            if len(x) == 1 and x.isascii() and x.isprintable():
                table[i] = x
    table |= dict.fromkeys(map(ord, INVISIBLE))
    return table


TABLE = _single()


def _ranges(codes: list[int]) -> str:
    out, codes = [], sorted(codes)
    i = 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(re.escape(chr(codes[i])) + ("-" + re.escape(chr(codes[j])) if j > i else ""))
        i = j + 1
    return "[" + "".join(out) + "]"


_ODD = re.compile(_ranges(list(TABLE)))
_HIDDEN = re.compile("[" + INVISIBLE + "]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_FIGURE = re.compile(r"[0-9+]|plus", re.I)
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_AT = r"(?:at|arroba)"
_DOT = r"(?:dot|punto|point|punkt)"
#: white space from its first character on, so that a long run is tried once
_SPACE = r"(?<!\s)\s+"
_BRACKET_AT = re.compile(rf"(?:{_SPACE})?[\[({{<]\s*(?:{_AT}|@)\s*[\])}}>]\s*", re.I)
_BRACKET_DOT = re.compile(rf"(?:{_SPACE})?[\[({{<]\s*(?:{_DOT}|\.)\s*[\])}}>]\s*", re.I)
#: what every match of the two above holds, without their spaces around it: quick to rule out
_BRACKETED = re.compile(rf"[\[({{<]\s*(?:{_AT}|@|{_DOT}|\.)\s*[\])}}>]", re.I)
_SPOKEN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?P<at>\s+{_AT}\s+|@)[A-Za-z0-9-]++(?P<dots>(?:(?:\s+{_DOT}\s+|\.)[A-Za-z0-9-]++)+)", re.I)
_AT_WORD = re.compile(rf"\s{_AT}\s", re.I)
_DOT_WORD = re.compile(rf"{_SPACE}{_DOT}\s+", re.I)
_NUMBER = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_SEP = r"[\s,-]+"
_RUN = re.compile(rf"(?<!\w)(?:(?:plus[\s-]|\+)[\s-]*)?{_NUMBER}(?!\w)(?:{_SEP}(?:{_DOT}{_SEP})?{_NUMBER}(?!\w))*", re.I)
#: spelled digits that are undone wherever they stand
LONG_RUN = 4
_SIGNS = r"[\s,().-]"
_GAP = re.compile(rf"{_SIGNS}+(?:{_DOT}{_SIGNS}+)?", re.I)
_AFTER = re.compile(rf"{_GAP.pattern}[0-9]", re.I)
_SIGN = re.compile(_SIGNS)
_DOT_END = re.compile(rf"{_DOT}\Z", re.I)
_DOT_FIGURES = re.compile(rf"(?<=[0-9])\s+{_DOT}\s+(?=[0-9])", re.I)
_PART = re.compile(rf"(?P<plus>plus|\+)|(?P<n>{_NUMBER})(?!\w)|(?P<dot>{_DOT})", re.I)

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i & 1:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def emails(t: str) -> list[Span]:
    out, pos = [], 0
    a = t.find("@")
    while a >= 0:
        s = a
        while s > pos and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, a + 1) if s < a else None
        if m:
            out.append((s, m.end()))
            pos = m.end()
        a = t.find("@", max(a + 1, pos))
    return out


def _byte(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) < 3 or len(x) == 3 and x <= "255"


def ips(t: str) -> list[Span]:
    out = []
    for m in _CHAIN.finditer(t):
        if "." not in m[0]:
            continue
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(map(_byte, parts[i : i + 4])):
                out.append((at, at + size))
            at += size + 1
    return out


def cards(t: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 12:
            d = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def phones(t: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in t else []


def base_spans(t: str) -> dict[str, list[Span]]:
    found: dict[str, list[Span]] = {}
    if "@" in t:
        found["email"] = emails(t)
    if _DIGIT.search(t):
        found |= {"ip": ips(t), "card": cards(t), "phone": phones(t)}
    return {k: v for k, v in found.items() if v}


class Mapped:
    """A text with the source span of each of its characters, and whether it was changed."""

    def __init__(self, text: str, start: list[int], end: list[int], changed: bytearray):
        self.text, self.start, self.end, self.changed = text, start, end, changed

    @classmethod
    def of(cls, t: str) -> Mapped:
        return cls(t, list(range(len(t))), list(range(1, len(t) + 1)), bytearray(len(t)))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace disjoint spans, in order; a new character stands for the whole of its span."""
        text, start, end, changed, at = [], [], [], bytearray(), 0
        for a, b, new in edits:
            text += self.text[at:a], new
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            changed += self.changed[at:a] + b"\1" * len(new)
            at = b
        return Mapped("".join([*text, self.text[at:]]), start + self.start[at:], end + self.end[at:], changed + self.changed[at:])


def _letters(x: Mapped) -> Mapped:
    for m in _ODD.finditer(x.text):
        x.changed[m.start()] = 1
    x.text = "".join(TABLE.get(ord(c), c) or c for c in x.text) if not x.text.isascii() else x.text
    gone = [(m.start(), m.end(), "") for m in _HIDDEN.finditer(x.text)]
    if not gone:
        return x
    # what follows a vanished character counts as changed, so that a match over it is new
    for _, b, _ in gone:
        if b < len(x.changed):
            x.changed[b] = 1
    return x.rewrite(gone)


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    out, at = [], m.start()
    for p in _PART.finditer(m[0]):
        a, b = m.start() + p.start(), m.start() + p.end()
        new = "+" if p["plus"] else "." if p["dot"] else DIGITS[p["n"].lower()]
        out.append((at if new == "." or out else a, b, new))
        at = b
    return out


def _has_dot_word(t: str) -> bool:
    low = t.lower().replace("i\u0307", "i")  # what a dotted capital I becomes, which patterns take for an i
    return any(w in low for w in ("dot", "punto", "point", "punkt"))


#: what follows the last dot of a host name
_TOP = re.compile(r"[A-Za-z]{2,}\Z")


def _at_and_dot(x: Mapped) -> Mapped:
    if _BRACKETED.search(x.text):
        for pattern, new in ((_BRACKET_AT, "@"), (_BRACKET_DOT, ".")):
            edits = [(m.start(), m.end(), new) for m in pattern.finditer(x.text)]
            if edits:
                x = x.rewrite(edits)
    if _has_dot_word(x.text) or _AT_WORD.search(x.text):
        edits = []
        for m in _SPOKEN.finditer(x.text):
            dots = [(d.start(), d.end(), ".") for d in _DOT_WORD.finditer(x.text, m.start("dots"), m.end("dots"))]
            said = m["at"] != "@"
            # an address in words, or an at word before the name of a host
            if dots or said and _TOP.search(m["dots"]):
                edits += ([(m.start("at"), m.end("at"), "@")] if said else []) + dots
        if edits:
            x = x.rewrite(edits)
    return x


def _before(t: str, i: int) -> bool:
    """Whether a figure stands beside what begins at i: before signs (and a dot word among them), or a plus before signs."""
    a = i
    while a and _SIGN.match(t, a - 1):
        a -= 1
    if a and t[a - 1] == "+":
        return True
    if a == i:
        return False
    if a and t[a - 1] in _ASCII_DIGITS:
        return True
    word = _DOT_END.search(t, max(0, a - 5), a)
    if not word:
        return False
    b = a = word.start()
    while a and _SIGN.match(t, a - 1):
        a -= 1
    return a < b and a > 0 and t[a - 1] in _ASCII_DIGITS


_ASCII_DIGITS = frozenset("0123456789")


def _beside_figures(x: Mapped) -> Mapped:
    """Short runs of spelled digits beside figures or a plus, and dot words between figures."""
    t = x.text
    runs = list(_RUN.finditer(t))
    on = [m[0][0] in "+pP" or bool(_AFTER.match(t, m.end())) or _before(t, m.start()) for m in runs]
    if any(on):
        linked = [bool(_GAP.fullmatch(t, a.end(), b.start())) for a, b in itertools.pairwise(runs)]
        for i, near in enumerate(linked):
            on[i + 1] |= near and on[i]
        for i in range(len(linked) - 1, -1, -1):
            on[i] |= linked[i] and on[i + 1]
        x = x.rewrite([e for m, yes in zip(runs, on, strict=True) if yes for e in _spelled(m)])
    dots = [(m.start(), m.end(), ".") for m in _DOT_FIGURES.finditer(x.text)] if _has_dot_word(x.text) else []
    return x.rewrite(dots) if dots else x


def _new_spans(x: Mapped, before: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Source spans of matches that hold a changed character and touch none of their kind found before."""
    out = {}
    for kind, spans in base_spans(x.text).items():
        new = []
        for a, b in spans:
            if any(x.changed[a:b]):
                s, e = min(x.start[a:b]), max(x.end[a:b])
                if not any(p < e and s < q for p, q in before.get(kind, ())):
                    new.append((s, e))
        if new:
            out[kind] = new
    return out


def hidden_spans(t: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the transducers bring out."""
    x = None
    if not t.isascii() and _ODD.search(t):
        x = _letters(Mapped.of(t))
    seen = x.text if x else t
    if _has_dot_word(seen) or _BRACKETED.search(seen) or _AT_WORD.search(seen):
        x = _at_and_dot(x or Mapped.of(t))
    said = [(m, _spelled(m)) for m in _RUN.finditer(x.text if x else t)]
    said = [(m, e) for m, e in said if sum(new.isdigit() for *_, new in e) >= LONG_RUN]
    calls = []
    if said:
        x = x or Mapped.of(t)
        calls = [(x.start[m.start()], x.end[m.end() - 1]) for m, e in said if all(new.isdigit() for *_, new in e) and 9 <= len(e) <= 15]
        x = x.rewrite([y for _, e in said for y in e])
    out = _new_spans(x, base) if x and any(x.changed) else {}
    # as many digits as a phone number has, in words alone, are one without a plus unless they are part of something else
    taken = [s for found in (base, out) for v in found.values() for s in v]
    calls = [(a, b) for a, b in calls if not any(p < b and a < q for p, q in taken)]
    if calls:
        out["phone"] = out.get("phone", []) + calls
    if _FIGURE.search(x.text if x else t):
        x = x or Mapped.of(t)
        y = _beside_figures(x)
        if y is not x:
            for kind, spans in _new_spans(y, {k: base.get(k, []) + out.get(k, []) for k in KINDS}).items():
                out[kind] = out.get(kind, []) + spans
    return out


def find(t: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by start, then kind as listed."""
    base = base_spans(t)
    all_ = [(k, a, b, True) for k, v in base.items() for a, b in v] + [(k, a, b, False) for k, v in hidden_spans(t, base).items() for a, b in v]
    return sorted(all_, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, spans array<struct<kind,start,end,base>>."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            spans = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in find(t)] for t in part.column("text").fill_null("").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(spans, _SPANS)], ["id", "spans"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(out, run, f"id {kind}, spans array<struct<kind:string,start:bigint,`end`:bigint,base:boolean>>").withColumnRenamed("id", id_col)
