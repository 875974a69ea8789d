"""Operator 1: personal data, with offset-preserving deobfuscation.

Base spans follow fixed patterns (see base_spans). Then a chain of transducers rewrites the text:
homoglyphs and full-width forms become ASCII, invisible characters go, spelled digits become
digits, and disguised "at" and "dot" become @ and a dot. Each transducer returns, for every output
character, the range of input characters it stands for, so a span that is detected in the
normalised text maps back to the source. Only spans that a rewriting took part in, that
are valid by the stricter rules in `_found`, and that touch no base span are added.

A null or empty text has no spans. Offsets are code points, ends exclusive. Rows are handled one by
one, so repeated rows and ties need no care; memory is bounded by the longest text (16 bytes a
character where something was rewritten), and time grows with its length: a chain of words and disguised
dots is walked once, repeats are possessive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A run of digits that starts inside another one can only fail as that did, so the looks behind
# and the possessive repeats change no match; they keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches; walks outward from each @, so it is linear."""
    out: list[Span] = []
    floor, at = 0, text.find("@")  # floor: the end of the last match
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    """The base spans of each kind: leftmost, non-overlapping, failing matches dropped."""
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if "." in text else [],
        "card": cards(text),
        "phone": phones(text) if "+" in text else [],
    }


class Tape:
    """A text on the way through the transducers, with the source range of every character."""

    def __init__(self, text: str):
        self.text = text
        self.start = self.end = np.zeros(0, np.int64)  # both are filled at the first rewriting
        self.touched: list[Span] = []

    def rewrite(self, pattern: re.Pattern, output) -> None:
        """Replace each match by output(match); every output character stands for the whole match.
        A None keeps the match as it is."""
        self.replace([(*m.span(), new) for m in pattern.finditer(self.text) if (new := output(m)) is not None])

    def replace(self, found: list[tuple[int, int, str]]) -> None:
        """Replace the ordered, disjoint parts (start, end, new text)."""
        if not found:
            return
        if not self.touched:
            self.start = np.arange(len(self.text))
            self.end = self.start + 1
        a, b = (np.array(x) for x in ([f[0] for f in found], [f[1] for f in found]))
        lo, hi = self.start[a], self.end[b - 1]
        text, at = [], 0
        for x, y, new in found:
            text += [self.text[at:x], new]
            at = y
        self.text = "".join([*text, self.text[at:]])
        # of the matches nothing stays; then each new character goes in front of what followed its match
        stay = np.ones(len(self.start), bool)
        edge = np.zeros(len(self.start) + 1, np.int64)
        edge[a] += 1
        edge[b] -= 1
        stay = np.cumsum(edge[:-1]) == 0
        size = np.array([len(f[2]) for f in found])
        into = np.repeat(np.cumsum(stay)[a] if len(a) else a, size)
        self.start = np.insert(self.start[stay], into, np.repeat(lo, size))
        self.end = np.insert(self.end[stay], into, np.repeat(hi, size))
        self.touched += list(zip(lo.tolist(), hi.tolist()))

    def source(self, a: int, b: int) -> Span:
        return int(self.start[a]), int(self.end[b - 1])


_LOOKALIKE = dict(zip("аеорсухіјѕһԁԛԝВЕКМНОРСТХАЅІЈкмтвνοαρτυικεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwBEKMHOPCTXASIJkmtbvoaptuikeABEZHIKMNOPTYX"))
_LOOKALIKE |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_LOOKALIKE |= {"﹫": "@", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
_LOOKALIKE |= {chr(base + d): str(d) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_HOMOGLYPH = re.compile("[" + re.escape("".join(_LOOKALIKE)) + "]")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_NUMBER = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "niner": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
}
_DIGIT_WORD = "|".join(sorted(_NUMBER, key=len, reverse=True))
_TIMES = r"(?:(?:double|triple)[ -]+)?"
_SPELLED = re.compile(rf"(?<!\w)(?:{_TIMES}(?:{_DIGIT_WORD})|[0-9])(?:[ ,-]{{1,3}}(?:{_TIMES}(?:{_DIGIT_WORD})(?!\w)|[0-9]+(?!\w))){{3,}}", re.I)
_ONE = re.compile(rf"(?:(double|triple)[ -]+)?({_DIGIT_WORD})(?!\w)|([0-9]+)", re.I)
_PLUS = re.compile(rf"(?<!\w)plus[ -]{{1,2}}(?=[0-9]|{_TIMES}(?:{_DIGIT_WORD})(?!\w))", re.I)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT_IN, _DOT_IN = "at|ät|arroba|arobase|chez|@", r"dot|punkt|punto|point|\."
_DOT_SPACED = "dot|punkt|punto"
_AT = rf"(?:\s?{_OPEN}\s?(?:{_AT_IN})\s?{_CLOSE}\s?|\sat\s|\s@\s|\s?&#64;\s?)"
_DOT = rf"(?:\s?{_OPEN}\s?(?:{_DOT_IN})\s?{_CLOSE}\s?|\s(?:{_DOT_SPACED})\s)"
# The parts of a disguised address; each is possessive, as none can end where the next one begins.
_CHAIN = re.compile(rf"(?<![\w.%+-])[A-Za-z0-9_%+-]++(?:(?:\.|{_DOT})[A-Za-z0-9_%+-]++)*+", re.I)
_AFTER = re.compile(rf"({_AT}|@)([A-Za-z0-9-]++)((?:(?:\.|{_DOT})[A-Za-z0-9-]++)++)", re.I)
_DOTS = re.compile(_DOT, re.I)
_DISGUISED_IP = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:(?:\.|{_DOT})[0-9]{{1,3}}){{3}}(?![\w])", re.I)
_PROSE = frozenset("a an the this that these those his her its our your my their one all any each every".split())
# Gates, of the same parts as the transducers: what these don't find, the transducers can't rewrite.
# A spelled run ends in three or more pieces behind separators; the letters only stop most tries early.
_FIRST = "".join(sorted({w[0] for w in [*_NUMBER, "double", "triple"]}))
_RUN = re.compile(rf"(?:[ ,-]{{1,3}}(?=[0-9{_FIRST}])(?:{_TIMES}(?:{_DIGIT_WORD})|[0-9]+)(?!\w)){{3}}", re.I)
# A plain @ and a bare "at" are rewritten only beside a disguised dot.
_BRACKETED = re.compile(rf"{_OPEN}\s?(?:{_AT_IN}|{_DOT_IN})\s?{_CLOSE}", re.I)
_SPACED = re.compile(rf"\s(?=[@{''.join(sorted({w[0].lower() for w in _DOT_SPACED.split('|')}))}])(?:@|{_DOT_SPACED})\s", re.I)
_DOUBTFUL = frozenset(("un", "uno", "null", "oh"))  # runs of these alone are words


def _spelled(m: re.Match) -> str | None:
    if not re.search("[a-z]", m[0], re.I):
        return None
    out = []
    parts = _ONE.findall(m[0])
    if all(word.lower() in _DOUBTFUL for _, word, _ in parts):
        return None
    for times, word, digits in parts:
        out.append(digits or str(_NUMBER[word.lower()]) * {"": 1, "double": 2, "triple": 3}[times.lower()])
    return "".join(out)


def normalise(text: str) -> Tape:
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(_INVISIBLE, lambda m: "")
        tape.rewrite(_HOMOGLYPH, lambda m: _LOOKALIKE[m[0]])
    tape.rewrite(_PLUS, lambda m: "+")
    if _RUN.search(tape.text):
        tape.rewrite(_SPELLED, _spelled)

    if _disguises(tape.text):
        tape.replace(_addresses(tape.text))
        tape.rewrite(_DISGUISED_IP, lambda m: _DOTS.sub(".", m[0]) if _DOTS.search(m[0]) else None)
    return tape


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Disguised addresses and their plain forms. A chain that no "at" follows is passed over whole."""
    out, at = [], 0
    while chain := _CHAIN.search(text, at):
        at = chain.end()
        m = _AFTER.match(text, at)
        if not m:
            continue
        if m[1] == "@" and not _DOTS.search(chain[0]) and not _DOTS.search(m[3]):
            continue
        if m[1].strip().lower() == "at" and (not _DOTS.search(m[3]) or m[2].lower() in _PROSE):
            continue  # "look at example.com" and "at the dot" are prose
        out.append((chain.start(), m.end(), _DOTS.sub(".", chain[0]) + "@" + m[2] + _DOTS.sub(".", m[3])))
        at = m.end()
    return out


def _disguises(text: str) -> bool:
    """Is there a disguised @ or dot other than a bare "at"?"""
    return "&#64;" in text or bool(_BRACKETED.search(text) or _SPACED.search(text))


def _overlaps(spans: list[Span], a: int, b: int) -> bool:
    i = bisect_left(spans, (b,))
    return i > 0 and spans[i - 1][1] > a


def disguised_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that the transducers bring to light, apart from the base spans."""
    none: dict[str, list[Span]] = {k: [] for k in KINDS}
    tape = normalise(text)
    if not tape.touched:
        return none
    touched = _merge(tape.touched)
    taken = _merge([s for v in base.values() for s in v])
    out = none
    for kind, spans in base_spans(tape.text).items():
        for a, b in spans:
            s = tape.source(a, b)
            if _overlaps(touched, *s) and not _overlaps(taken, *s) and _sure(kind, tape.text[a:b]):
                out[kind].append(s)
        out[kind].sort()
        kept: list[Span] = []
        for s in out[kind]:
            if not kept or kept[-1][1] <= s[0]:
                kept.append(s)
        out[kind] = kept
    return out


def _sure(kind: str, found: str) -> bool:
    """An address needs a top-level domain of letters; the other patterns check themselves."""
    return kind != "email" or bool(re.search(r"\.[A-Za-z]{2,}\Z", found))


def _merge(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(spans):
        if out and s[0] < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    extra = disguised_spans(text, base)
    return base, {k: sorted(base[k] + extra[k]) for k in KINDS}


def listing(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets."""
    _, spans = find(text)
    cut = sorted((a, b, k) for k in KINDS for a, b in spans[k])
    if not cut:
        return text
    out, at = [], 0
    for a, b, k in cut:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = b
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (doc_id, text) -> doc_id, counts of all spans by kind, base_sha256, spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(f"n_base_{k}" for k in KINDS)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(v.as_py() or "") for v in b.column(1)]
            cols = [b.column(0)]
            cols += [pa.array([len(a[k]) for _, a in found], pa.int64()) for k in KINDS]
            cols.append(pa.array([hashlib.sha256(listing(x).encode()).hexdigest() for x, _ in found], pa.string()))
            cols.append(pa.array([listing(a) for _, a in found], pa.string()))
            cols += [pa.array([len(x[k]) for x, _ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, {', '.join(f'n_base_{k} long' for k in KINDS)}"
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(rows, schema)


def redact_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in its text replaced; other columns stay, null stays null."""
    at = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if v is None else redact(v) for v in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    return docs.mapInArrow(rows, docs.schema)
