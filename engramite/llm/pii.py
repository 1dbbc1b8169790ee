"""Personal data: base patterns, and offset-preserving deobfuscation.

Base kinds are email, ip, card and phone. Beyond them, a chain of transducers rewrites a text into a
normal form (homoglyphs to ASCII, invisible characters removed, HTML entities resolved, spelled digits to
digits, at/dot disguises to ``@`` and ``.``) while each output character keeps the source range it came from.
The same detectors then run over the normal form, and each hit that rests on a rewritten character is mapped
back to source characters. Spans are code points, end exclusive.

Defined cases: a null text is empty and has no spans; the digest of no spans is that of an empty string; rows
are judged one by one, so repeated rows, null ids and extra columns change nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from engramite.llm.common import doc_id, map_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind holds off second starts within one run of digits: they could only fail as the first did.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Goes from each ``@`` back to where its run of local characters starts, as a leftmost match would."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        # The characters between two signs are looked at once: what lies before this sign ends at it.
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    return out


def detect(text: str) -> list[tuple[str, int, int]]:
    """Base spans in the order of kind, then start. A match that fails its test is dropped without a retry."""
    spans = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text) is None:
        return spans
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", *m.span()))
    return spans


# Letters of other scripts that look like ASCII letters.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i",
    "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ꓲ": "I",
    "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", " ": " ", " ": " ", " ": " ",
}
# Characters without width.
_INVISIBLE = "­​‌‍⁠﻿‎‏"


def _glyphs() -> dict[str, str]:
    """One character to at most one ASCII character. Full-width forms, other scripts' digits and the
    mathematical alphabets follow from their compatibility decompositions."""
    table = dict(_LOOKALIKES) | dict.fromkeys(_INVISIBLE, "")
    for lo, hi in ((0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x24B6, 0x24E9), (0x2460, 0x2468)):
        for c in map(chr, range(lo, hi + 1)):
            n = unicodedata.normalize("NFKC", c)
            if len(n) == 1 and n.isascii():
                table.setdefault(c, n)
    for lo, hi in ((0x0660, 0x0669), (0x06F0, 0x06F9), (0x0966, 0x096F), (0x09E6, 0x09EF)):
        for c in map(chr, range(lo, hi + 1)):
            table.setdefault(c, str(unicodedata.digit(c)))
    return table


_GLYPHS = _glyphs()
_ENTITY = re.compile(r"&(?:#0*(\d{2,5})|#[xX]0*([0-9a-fA-F]{2,4})|(commat|period|plus|hyphen));")
_NAMED = {"commat": "@", "period": ".", "plus": "+", "hyphen": "-"}

# Digits spelled out.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# What the patterns below also take for i and s, as they ignore case.
_FOLDED = {0x131: "i", 0x307: None, 0x17F: "s"}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
# A run of number words, digits and what may stand between them; at least three words or digits in a row.
_RUN = re.compile(
    rf"(?<!\w)(?:(?:plus|\+)[\s-]*+)?(?:{_WORD}|[0-9]+)(?:(?:[\s,-]++|\s*+\.\s*+|\s++(?:dot|point|punkt|punto)\s++|\s*+[()]\s*+)(?:(?:double|triple)\s++)?(?:{_WORD}|[0-9]+)(?!\w)){{3,}}",
    re.IGNORECASE,
)
_PART = re.compile(rf"(plus)[\s-]*|(double|triple)\s+|({_WORD})(?!\w)|\s+(dot|point|punkt|punto)\s+|([0-9]+)", re.IGNORECASE)
_SEPARATOR = re.compile(r"[\s,-]+")
_HAS_WORD = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)", re.IGNORECASE)

_AT = r"at|arroba|arobase|klammeraffe"
_DOT = r"dot|punto|punkt|point"
# Runs of any length begin where nothing of their kind is before them, so each is read once.
_BRACKETED = re.compile(rf"(?<!\s)\s*+(?:[\[({{<]\s*+|(?<!_)_++|(?<!-)-++)(?:({_AT}|@)|({_DOT}|\.))(?:\s*+[\])}}>]|_++|-++)\s*+", re.IGNORECASE)
# local (dot local)* at label dot label (dot label)*, all in words; or with spaces about the signs. A full stop before a space ends a sentence.
# A chain of labels that no address follows is passed over as a whole.
_LABELS = r"[A-Za-z0-9._%+-]++"
_DOT_WORD = rf"\s+(?:{_DOT})\s+"
_HOST = rf"(?:\s++(?:{_AT})\s++[A-Za-z0-9-]+(?:{_DOT_WORD}[A-Za-z0-9-]+)+|\s*+@\s*+[A-Za-z0-9-]+(?:(?:{_DOT_WORD}|\s+\.\s+|\.)[A-Za-z0-9-]+)+)"
_SPACED = re.compile(rf"(?<![A-Za-z0-9._%+-]){_LABELS}(?:(?:{_DOT_WORD}{_LABELS})++({_HOST})?+|({_HOST}))", re.IGNORECASE)
_SIGN = re.compile(rf"\s+(?:({_AT})|({_DOT}))\s+|\s*(@)\s*|\s*(\.)\s*", re.IGNORECASE)


class _Tape:
    """A text with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text, self.lo, self.hi, self.new = text, None, None, None

    def _open(self) -> None:
        if self.lo is None:
            n = len(self.text)
            self.lo, self.hi, self.new = list(range(n)), list(range(1, n + 1)), [False] * n

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, replacement), in order, without overlaps. What is replaced gives its whole range
        to each new character; what is removed joins the next character's range."""
        edits = [e for e in edits if self.text[e[0] : e[1]] != e[2]]
        if not edits:
            return
        self._open()
        text, lo, hi, new, pos = [], [], [], [], 0
        for a, b, put in edits:
            text.append(self.text[pos:a])
            lo += self.lo[pos:a]
            hi += self.hi[pos:a]
            new += self.new[pos:a]
            text.append(put)
            for _ in put:
                lo.append(self.lo[a])
                hi.append(self.hi[b - 1])
                new.append(True)
            if not put and new:
                new[-1] = True
            pos = b
        text.append(self.text[pos:])
        lo += self.lo[pos:]
        hi += self.hi[pos:]
        new += self.new[pos:]
        self.text, self.lo, self.hi, self.new = "".join(text), lo, hi, new


def _numbers(m: re.Match) -> list[tuple[int, int, str]]:
    """Edits that turn a run of number words into digits; words lose what stands between them, digits keep theirs."""
    edits, s, times, last_word, last_end = [], m[0], 1, False, None
    if not _HAS_WORD.search(s):
        return []
    for p in _PART.finditer(s):
        a, b = p.span()
        plus, many, word, dot, digits = p.groups()
        if word and last_word and last_end is not None and _SEPARATOR.fullmatch(s, last_end, a):
            edits.append((m.start() + last_end, m.start() + a, ""))
        if plus:
            edits.append((m.start() + a, m.start() + b, "+"))
        elif many:
            times = 2 if many.lower() == "double" else 3
            if last_word and last_end is not None and _SEPARATOR.fullmatch(s, last_end, a):
                edits.append((m.start() + last_end, m.start() + a, ""))
            edits.append((m.start() + a, m.start() + b, ""))
            last_end = b
            continue
        elif word:
            edits.append((m.start() + a, m.start() + b, DIGIT_WORDS[word.lower().translate(_FOLDED)] * times))
        elif dot:
            edits.append((m.start() + a, m.start() + b, "."))
        times, last_word, last_end = 1, bool(word), b
    return edits


def normalise(text: str) -> _Tape:
    """The chain of transducers. A transducer without a trigger in the text costs one scan; each trigger is a part
    that every match of its transducer has, built from the same tables."""
    tape = _Tape(text)
    if not text.isascii() and not _GLYPHS.keys().isdisjoint(text):
        tape.rewrite([(i, i + 1, _GLYPHS[c]) for i, c in enumerate(text) if c in _GLYPHS])
    if "&" in tape.text:
        edits = []
        for m in _ENTITY.finditer(tape.text):
            code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else ord(_NAMED[m[3]])
            if 32 <= code < 127:
                edits.append((m.start(), m.end(), chr(code)))
        tape.rewrite(edits)
    if _HAS_WORD.search(tape.text):
        tape.rewrite([e for m in _RUN.finditer(tape.text) for e in _numbers(m)])
    if _BRACKET_HINT.search(tape.text):
        text = tape.text
        tape.rewrite([(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(text) if _between_words(text, m)])
    if _SPACED_HINT.search(tape.text):
        edits = []
        for m in _SPACED.finditer(tape.text):
            for s in () if m[1] is None and m[2] is None else _SIGN.finditer(tape.text, *m.span()):
                edits.append((s.start(), s.end(), "@" if s[1] or s[3] else "."))
        tape.rewrite(edits)
    return tape


_BRACKET_HINT = re.compile(rf"[\[({{<_-]\s*+(?:{_AT}|{_DOT}|@|\.)\s*+[\])}}>_-]", re.IGNORECASE)
_SPACED_HINT = re.compile(rf"@|\s(?:{_DOT})\s", re.IGNORECASE)


def _between_words(text: str, m: re.Match) -> bool:
    return m.start() > 0 and m.end() < len(text) and text[m.start() - 1].isalnum() and text[m.end()].isalnum()


def deobfuscate(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans, in source characters, that only the normal form shows. One inside a base span of its kind is left out."""
    tape = normalise(text)
    if tape.lo is None:
        return []
    added = set()
    for kind, a, b in detect(tape.text):
        if not any(tape.new[a:b]):
            continue
        lo, hi = min(tape.lo[a:b]), max(tape.hi[a:b])
        while lo < hi and text[lo].isspace():
            lo += 1
        while hi > lo and text[hi - 1].isspace():
            hi -= 1
        if not any(k == kind and x <= lo and hi <= y for k, x, y in base):
            added.add((kind, lo, hi))
    return sorted(added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans."""
    base = detect(text)
    return base, deobfuscate(text, base)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(documents: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, and how many the method added."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
            for text in texts_of(batch):
                base, added = find(text)
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
                out["n_added"].append(len(added))
            return out | {"doc_id": batch.column("doc_id")}

        return work

    return map_batches(documents.select(doc_id(documents).alias("doc_id"), documents["text"]), make, SCHEMA)


def mask(text: str) -> str:
    """The text with each span, or union of overlapping spans, replaced by the kind of its first."""
    base, added = find(text)
    if not base and not added:
        return text
    out, pos = [], 0
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if b <= pos:
            continue
        if a >= pos:
            out += [text[pos:a], f"<{kind.upper()}>"]
        pos = b
    return "".join([*out, text[pos:]])
