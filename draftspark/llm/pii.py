"""Personal data in texts, plain and disguised, with offsets in the source.

Base identifiers (email, ip, card, phone) are found in the text as it stands.
Disguised ones are found after a cascade of transducers, each of which rewrites
a text and carries, for every character of its output, the span of source
characters that it stands for: look-alike characters become ASCII and invisible
ones vanish; runs of spelled digits become digits, as do shorter ones beside
figures (``555 five 0199``); ``[at]``, ``(dot)`` and the
like become ``@`` and ``.``, and so does ``name at host dot ca`` with any two
letters or a common ending last.  Identifiers found in the result are mapped back
through these spans.  Base spans always stay; a mapped span is added unless it
lies inside a base span of its kind.

Offsets are code points, ends exclusive.  Defined results: null and empty texts
have no spans; malformed UTF-8 bytes count as one replacement character each;
repeated rows are independent; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import operator
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

KINDS = ("email", "ip", "card", "phone")

# --- base detection ------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+\.[0-9]+(\.[0-9]+))?")  # takes every run of digits, so that no start within one is tried
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost address around each ``@``: the run of local characters
    before it (after any earlier match) and the host behind it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at) if start < at else None
        if host:
            done = host.end()
            out.append((start, done))
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if m[1] and all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


_A_DIGIT = re.compile("[0-9]")


def identifiers(text: str) -> list[tuple[str, int, int]]:
    if not _A_DIGIT.search(text):
        return [("email", a, b) for a, b in emails(text)]
    return [(kind, a, b) for kind in KINDS for a, b in FINDERS[kind](text)]


# --- transducers ----------------------------------------------------------------

# Letters of other scripts that look like an ASCII letter.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H",
    "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "L", "ѐ": "e",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "·": ".", " ": " ", " ": " ", " ": " ", "　": " ",
}
# Characters that take no room.
INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣﻿"
# Digits as words.
DIGIT_WORDS = {
    "0": ("zero", "oh", "null", "zéro", "cero"), "1": ("one", "eins", "un", "uno"), "2": ("two", "zwei", "zwo", "deux", "dos"),
    "3": ("three", "drei", "trois", "tres"), "4": ("four", "vier", "quatre", "cuatro"), "5": ("five", "fünf", "cinq", "cinco"),
    "6": ("six", "sechs", "seis"), "7": ("seven", "sieben", "sept", "siete"), "8": ("eight", "acht", "huit", "ocho"),
    "9": ("nine", "neun", "neuf", "nueve"),
}
# How at and dot are written out.
AT_WORDS, DOT_WORDS = ("at", "ät", "arroba", "arobase"), ("dot", "punkt", "point", "punto")
# Last parts of a host name that make a bare "at ... dot" an address.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "biz", "example", "test", "de", "fr", "es", "eu", "uk", "us", "at", "ch", "mx", "ar")
# Further last parts, taken where at and dot are both written out, as any two letters are.
SPELLED_ENDINGS = ("academy", "agency", "app", "blog", "cloud", "coop", "dev", "digital", "email", "global", "group", "int", "jobs", "live", "media", "mil", "mobi", "museum", "name", "news", "online", "page", "pro", "shop", "site", "solutions", "space", "store", "studio", "tech", "today", "website", "work", "world", "xyz")
# Two letters that are an English word and no country; words before a noun, which are no host.
NO_COUNTRIES = ("an", "go", "he", "hi", "if", "of", "oh", "ok", "on", "or", "ox", "up", "we")
BEFORE_NOUNS = ("a", "an", "any", "each", "every", "her", "his", "its", "my", "no", "one", "our", "some", "that", "the", "their", "this", "your")


class Mapped:
    """A text whose characters each stand for a span of the source."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str) -> Mapped:
        at = np.arange(len(text), dtype=np.int64)
        return cls(text, at, at + 1)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace spans (ascending, disjoint); each new character stands for
        the whole source span of what it replaces."""
        if not edits:
            return self
        text, starts, ends, done = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[done:a], new]
            starts += [self.starts[done:a], np.full(len(new), self.starts[a])]
            ends += [self.ends[done:a], np.full(len(new), self.ends[b - 1])]
            done = b
        text.append(self.text[done:])
        starts.append(self.starts[done:])
        ends.append(self.ends[done:])
        return Mapped("".join(text), np.concatenate(starts), np.concatenate(ends))


@functools.cache
def _plain() -> dict[int, str]:
    """Characters that stand for one ASCII character: the look-alikes, the
    decimal digits of other scripts, and compatibility forms of letters, digits
    and the marks that identifiers use."""
    table = {ord(c): p for c, p in LOOK_ALIKES.items()}
    for c in range(0x80, 0x20000):
        s = chr(c)
        if (d := unicodedata.decimal(s, None)) is not None:
            table[c] = str(d)
        elif unicodedata.category(s) in ("Lu", "Ll", "Po", "Pd", "Sm", "Ps", "Pe", "So") and len(p := unicodedata.normalize("NFKC", s)) == 1 and p.isascii() and (p.isalnum() or p in "@.+-_%()[]{}"):
            table.setdefault(c, p)
    return table


@functools.cache
def _odd() -> re.Pattern:
    """Characters that ``look_alikes`` changes.  Those past the basic plane are
    taken as one range, as long lists of them are searched one by one."""
    basic = [c for c in sorted(_plain()) if c < 0x10000]
    return re.compile("[" + "".join(map(re.escape, map(chr, basic))) + INVISIBLE + "]|[\U00010000-\U0010FFFF]")


def look_alikes(text: Mapped) -> Mapped:
    """One to one, or one to nothing: offsets change only where invisible
    characters go."""
    if text.text.isascii():
        return text
    plain = Mapped(text.text.translate(_plain()), text.starts, text.ends)
    return plain.rewrite([(m.start(), m.end(), "") for m in re.finditer(f"[{INVISIBLE}]+", plain.text)])


_DIGIT_OF = {w: d for d, names in DIGIT_WORDS.items() for w in names}
_DIGIT = r"(?:(?:double|triple)[ \t]+)?(?:" + "|".join(sorted(_DIGIT_OF, key=len, reverse=True)) + r")(?!\w)"
_DOT = r"[ \t]*(?:\.|[\[({<][ \t]*(?:\.|" + "|".join(DOT_WORDS) + r")[ \t]*[\])}>]|(?<=[ \t])(?:" + "|".join(DOT_WORDS) + r")(?=[ \t]))[ \t]*"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ \t]+)?{_DIGIT}(?:(?:[ \t]*[-,][ \t]*|[ \t]+|{_DOT}){_DIGIT}){{3,}}", re.I)
_BETWEEN = rf"(?:[ \t]*[-,][ \t]*|[ \t]+|{_DOT})"
_FEW = re.compile(rf"(?<!\w)(?P<plus>plus[ \t]+)?{_DIGIT}(?:{_BETWEEN}{_DIGIT})*", re.I)
_FIGURE_BEFORE, _FIGURE_AFTER = re.compile(rf"[0-9][)]?{_BETWEEN}(?=(?:plus[ \t]+)?{_DIGIT})", re.I), re.compile(rf"{_BETWEEN}[(]?[0-9]", re.I)
_SPELLED_PART = re.compile(rf"(?P<plus>plus[ \t]+)|(?P<digit>{_DIGIT})|(?P<dot>{_DOT})", re.I)


def _lower(text: str) -> str:
    """In lower case, with an i for the one letter that patterns take for it and lower() does not."""
    return text.replace("\u0130", "i").lower()


def _digits(word: str) -> str:
    words = _lower(word).split()
    return _DIGIT_OF[words[-1]] * {"double": 2, "triple": 3}.get(words[0], 1)


def spelled_digits(text: Mapped) -> Mapped:
    """Runs of four or more digit words become digits; what parts them goes,
    but for a dot.  In shorter runs with a figure beside them each word becomes a
    digit, and what parts them stays."""
    edits = []
    for m in _SPELLED.finditer(text.text):
        at = m.start()
        for part in _SPELLED_PART.finditer(text.text, m.start(), m.end()):
            if part.start() > at:
                edits.append((at, part.start(), ""))
            edits.append((part.start(), part.end(), _digits(part["digit"]) if part["digit"] else "+" if part["plus"] else "."))
            at = part.end()
    text, edits = text.rewrite(edits), []
    beside = {m.end() for m in _FIGURE_BEFORE.finditer(text.text)}
    for m in _FEW.finditer(text.text):
        if m.start() in beside or _FIGURE_AFTER.match(text.text, m.end()):
            edits += [(part.start(), part.end(), _digits(part["digit"]) if part["digit"] else "+")
                      for part in _SPELLED_PART.finditer(text.text, m.start(), m.end()) if part["digit"] or part["plus"]]
    return text.rewrite(edits)


_OPEN, _CLOSE = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
_AT, _DOTS = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_BOXED_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-]){_OPEN}(?:@|{_AT}){_CLOSE}(?=[A-Za-z0-9])", re.I)
_BOXED_DOT = re.compile(rf"(?<=[A-Za-z0-9-]){_OPEN}(?:\.|{_DOTS}){_CLOSE}(?=[A-Za-z0-9])", re.I)
_NUMBER_DOT = re.compile(rf"(?<=[0-9])[ \t]+(?:{_DOTS})[ \t]+(?=[0-9])", re.I)
_LOOSE_HOST = rf"[A-Za-z0-9-]{{1,63}}(?:(?:[ \t]+(?:{_DOTS})[ \t]+|[ \t]*\.[ \t]*)[A-Za-z0-9-]{{1,63}}){{0,5}}(?:[ \t]+(?:{_DOTS})[ \t]+|[ \t]*\.[ \t]*)(?:{'|'.join(ENDINGS)})(?![A-Za-z0-9-])"
_LOOSE = re.compile(rf"(?P<at>[ \t]+(?:{_AT})[ \t]+|[ \t]*@[ \t]*)(?P<host>{_LOOSE_HOST})", re.I)
# "at this point in" is no address: after a bare "at", "point" only goes with ENDINGS.
_CLEAR_AT, _CLEAR_DOT = "|".join(w for w in AT_WORDS if w != "at"), "|".join(w for w in DOT_WORDS if w != "point")


def _written_out(at: str, dots: str) -> str:
    dot = rf"[ \t]+(?:{dots})[ \t]+"
    return rf"[ \t]+(?:{at})[ \t]+(?!(?:{'|'.join(BEFORE_NOUNS)})[ \t])[A-Za-z0-9-]{{1,63}}(?:{dot}[A-Za-z0-9-]{{1,63}}){{0,5}}{dot}(?:(?!(?:{'|'.join(NO_COUNTRIES)})(?![A-Za-z0-9-]))[A-Za-z]{{2}}|{'|'.join(ENDINGS + SPELLED_ENDINGS)})(?![A-Za-z0-9-])"


_WRITTEN_OUT = re.compile(rf"{_written_out(_CLEAR_AT, _DOTS)}|{_written_out('at', _CLEAR_DOT)}", re.I)
_WRITTEN_AT = re.compile(rf"[ \t]+(?:{_AT})[ \t]+", re.I)
_LOOSE_DOT = re.compile(rf"[ \t]+(?:{_DOTS})[ \t]+|[ \t]*\.[ \t]*", re.I)


def at_and_dot(text: Mapped) -> Mapped:
    """Boxed forms first, then ``name at host dot ca``, all in words, then spaced
    ``@`` and mixed forms before the common endings."""
    for pattern, new in ((_BOXED_AT, "@"), (_BOXED_DOT, "."), (_NUMBER_DOT, ".")):
        text = text.rewrite([(m.start(), m.end(), new) for m in pattern.finditer(text.text)])
    edits = []
    for m in _WRITTEN_OUT.finditer(text.text):
        if m.start() and text.text[m.start() - 1] in _LOCAL:
            at = _WRITTEN_AT.match(text.text, m.start()).end()
            edits.append((m.start(), at, "@"))
            edits += [(d.start(), d.end(), ".") for d in _LOOSE_DOT.finditer(text.text, at, m.end())]
    text, edits = text.rewrite(edits), []
    for m in _LOOSE.finditer(text.text):
        if m.start() and text.text[m.start() - 1] in _LOCAL and (m["at"] != "@" or _LOOSE_DOT.sub(".", m["host"]) != m["host"]):
            edits.append((m.start("at"), m.end("at"), "@"))
            edits += [(d.start(), d.end(), ".") for d in _LOOSE_DOT.finditer(text.text, m.start("host"), m.end("host"))]
    return text.rewrite(edits)


TRANSDUCERS = (look_alikes, spelled_digits, at_and_dot)
_BOX = re.compile(rf"[\[({{<][ \t]*(?:@|\.|{_AT}|{_DOTS})[ \t]*[\])}}>]", re.I)
_PARTING, _FIGURES = str.maketrans("-,.()", "     "), frozenset("0123456789")
_PARTED = tuple(f"{sep}{w}" for w in DOT_WORDS for sep in " \t")
# One pattern for each at-word and for @, as a search for a fixed start is fast; for texts in lower case.
_BEFORE_HOST = tuple(re.compile(rf"{w}[ \t]+{_LOOSE_HOST}") for w in AT_WORDS)
_SIGN_HOST = re.compile(rf"@{_LOOSE_HOST}")


def disguised(text: str) -> bool:
    """Whether any transducer can change something that matters: quick tests
    that only ever err on the side of yes.  Each form that a pattern of the
    transducers accepts has its test here."""
    if not text.isascii() and _odd().search(text):
        return True
    if "@" in text and (" @" in text or "@ " in text or "\t@" in text or "@\t" in text):
        return True
    if any(c in text for c in "[({<") and _BOX.search(text):
        return True
    low = _lower(text)
    if any(w in low for w in _PARTED):
        return True
    if any(p.search(low) for p in _BEFORE_HOST):
        return True
    if "@" in low and any(" " in m.group() or "\t" in m.group() for m in _SIGN_HOST.finditer(low)):
        return True
    words = low.translate(_PARTING).split()
    if _DIGIT_OF.keys().isdisjoint(words):
        return False
    spelled = [w in _DIGIT_OF or w in ("double", "triple") for w in words]
    if any(map(operator.and_, spelled, spelled[1:])):
        return True
    return any(s and (i and words[i - 1][-1] in _FIGURES or i + 1 < len(words) and words[i + 1][0] in _FIGURES) for i, s in enumerate(spelled))


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of one text, by kind as listed, then start."""
    base = identifiers(text)
    if not disguised(text):
        return base, []
    mapped = Mapped.of(text)
    for transducer in TRANSDUCERS:
        mapped = transducer(mapped)
    added = {(kind, *mapped.source(a, b)) for kind, a, b in identifiers(mapped.text)} if mapped.text != text else set()
    own = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}
    new = [s for s in added if not any(a <= s[1] and s[2] <= b for a, b in own[s[0]])]
    return base, sorted(new, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and spans: array of (kind, start, end,
    base), base ones first."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.text_chunks(batch, "text"):
                data, offsets = K.utf8(part.column("text"))
                raw, cut, out = data.tobytes(), offsets.tolist(), []
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    base, added = find_spans(raw[a:b].decode("utf-8", "replace"))
                    out.append([{"kind": k, "start": s, "end": e, "base": own} for own, found in ((True, base), (False, added)) for k, s, e in found])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out, span)], ["row", "spans"])

    return rows.mapInArrow(K.tidy(run), K.schema(rows.select("row"), "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"))
