"""PII with offset-preserving deobfuscation.

Base identifiers (email, ip, card, phone) are found in the text as it stands. Then a chain of transducers normalises homoglyphs
and compatibility forms, spelled digits and at/dot disguises; each keeps, for every character that it writes, the span of source
characters that it stands for. Identifiers of the normalised text are mapped back, and those that touch no base span of any kind
are added. Offsets are code points of the whole text. Null and empty texts hold none.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: From the start of a run of digits only and without going back: finds what the plain pattern does, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

#: Letters of other scripts that look like Latin ones; compatibility forms come from NFKC.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅαοιρνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlABEKMHOPCTXIJSaoipvABEZHIKMNOPTYX"))
HOMOGLYPHS |= dict.fromkeys("‐‑‒–—−", "-") | {"․": ".", "。": ".", "｡": "."}
IGNORED = frozenset("​‌‍⁠﻿­")
DIGITS = {w: str(k) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for k, w in enumerate(words.split())} | {"oh": "0"}
_NUMBER = "|".join(sorted(DIGITS, key=len, reverse=True))
_WORD = rf"(?:{_NUMBER})(?!\w)"
_DOT = r"\s*[\[({<]\s*(?:dot|punkt|point|punto)\s*[\])}>]\s*|\s+(?:dot|punkt|punto|point)\s+|\."
_SPELLED_DOT = _DOT.removesuffix(r"|\.")
#: Numbers in words and digits, joined by space, punctuation or spelled dots.
SPELLED = re.compile(rf"(?<!\w)(?:plus[\s,-]+|\+[\s(]*)?(?:{_WORD}|[0-9]++)(?:(?:{_SPELLED_DOT}|[\s,().-]++)(?:{_WORD}|[0-9]++))+(?!\w)", re.I)
_OCTET = rf"(?:[0-9]++|{_WORD}(?:[\s,-]+{_WORD}){{0,2}})"
QUAD = re.compile(rf"(?<![\w.+]){_OCTET}(?:(?:{_DOT}){_OCTET}){{3}}(?!\w)", re.I)
_TAIL = re.compile(rf"[0-9]\)?(?:{_DOT})$", re.I)
_PIECE = re.compile(rf"\+|(?<!\w)(?:plus(?!\w)|{_WORD})|[0-9]+", re.I)
_AT = re.compile(r"[\[({<]\s*(?:at|ät|arroba|arobase)\s*[\])}>]|@|(?<=\s)(?:at|arroba|arobase)(?=\s)", re.I)
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:(?:{_DOT})[A-Za-z0-9-]+)+", re.I)
_NAME = "[A-Za-z0-9_%+-]+"
#: A local part from its end on, in reversed text.
_LOCAL = re.compile(rf"{_NAME}(?:(?:\s*[\])}}>]\s*(?:tod|tknup|tniop|otnup)\s*[\[({{<]\s*|\s+(?:tod|tknup|otnup|tniop)\s+|\.){_NAME})*", re.I)
_DOTS = re.compile(_DOT, re.I)
_SPACE = re.compile(r"\s*")
_TOP = re.compile(r"[A-Za-z]{2,}(?!\w)")
#: Top-level domains that make a bare "at" an address where the rest reads like prose.
_COMMON = frozenset("com org net edu gov info io de fr es uk eu co ch at it nl us ca dev me biz".split())
_PROSE = frozenset("the a an this that these those some any each every one no what which my your his her its our their".split())
_FORMS = re.compile("[" + re.escape("".join(HOMOGLYPHS)) + "".join(IGNORED) + "＀-￯⁰-ₜ①-⓿。\U0001d400-\U0001d7ff٠-٩۰-۹०-९]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    """As EMAIL.finditer, from each @ on: no rescans of long runs of letters."""
    last, pos = 0, text.find("@")
    while pos >= 0:
        a = pos
        while a > last and (text[a - 1].isascii() and text[a - 1].isalnum() or text[a - 1] in "._%+-"):
            a -= 1
        m = DOMAIN.match(text, pos) if a < pos else None
        if m:
            yield a, m.end()
            last = m.end()
        pos = text.find("@", max(pos + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if text.count(".") >= 3:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in (p.lstrip("0")[:4] or "0" for p in m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class Tape:
    """A text with, for each of its characters, the source span that it stands for."""

    def __init__(self, text: str, starts=None, ends=None):
        self.text = text
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def rewrite(self, edits) -> Tape:
        """edits: (start, end, new) of this text, ascending and apart; each new character stands for the whole replaced span."""
        if not edits:
            return self
        out, starts, ends, pos = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[pos:a], new]
            s, e = (self.starts[a], self.ends[b - 1])
            starts += [*self.starts[pos:a], *[s] * len(new)]
            ends += [*self.ends[pos:a], *[e] * len(new)]
            pos = b
        return Tape("".join(out) + self.text[pos:], [*starts, *self.starts[pos:]], [*ends, *self.ends[pos:]])


def _forms(t: Tape) -> Tape:
    edits = []
    for m in _FORMS.finditer(t.text):
        c = m[0]
        new = "" if c in IGNORED else HOMOGLYPHS.get(c) or (str(unicodedata.digit(c)) if unicodedata.digit(c, None) is not None else unicodedata.normalize("NFKC", c))
        if new != c:
            edits.append((m.start(), m.end(), new))
    return t.rewrite(edits)


def _joined(m, at: int) -> list[tuple[int, int, str]]:
    """Edits that leave of a match its digits, with the plus before them; each piece takes what follows it up to the next."""
    pieces = [*_PIECE.finditer(m)]
    ends = [p.start() for p in pieces[1:]] + [pieces[-1].end()]
    return [(at + p.start(), at + e, "+" if p[0].lower() == "plus" else DIGITS.get(p[0].lower(), p[0])) for p, e in zip(pieces, ends)]


def _digits(t: Tape) -> Tape:
    edits, pos = [], 0

    def numbers(start: int, end: int) -> None:
        for m in SPELLED.finditer(t.text, start, end):
            new = _joined(m[0], m.start())
            digits = sum(len(x) for *_, x in new if x != "+")
            if digits >= 8 and not re.fullmatch(r"[0-9\s,().+-]+", m[0]):  # a number, not a count in prose
                edits.extend(new)

    for m in QUAD.finditer(t.text):
        new, at = [], m.start()
        if _TAIL.search(t.text[max(0, at - 12) : at]):
            continue  # the end of a longer chain, as of a phone number
        dots = [*_DOTS.finditer(m[0])]
        for a, b in zip([0, *(d.end() for d in dots)], [*(d.start() for d in dots), len(m[0])]):
            new += _joined(m[0][a:b], at + a)
        new = sorted([*new, *((at + d.start(), at + d.end(), ".") for d in dots)])
        if all(int(x[-4:]) <= 255 for x in "".join(x for *_, x in new).split(".")):
            numbers(pos, at)
            edits += [e for e in new if e[2] != t.text[e[0] : e[1]]]
            pos = m.end()
    numbers(pos, len(t.text))
    return t.rewrite(edits)


def _prose(at: str, name: str, labels: list[str], dots: list[str]) -> bool:
    """Whether a bare "at" between these is a word of a sentence: "look at example.com", "look at the point where"."""
    common = labels[-1].lower() in _COMMON
    spelled = [d.strip().lower() for d in dots if d != "."]
    if any(d[0] in "[({<" for d in spelled):
        return False
    if not spelled:
        return at != "AT" or not common and name == name.upper()
    return not common and ("point" in spelled or labels[0].lower() in _PROSE)


def _addresses(t: Tape) -> Tape:
    edits, done, text, turned = [], 0, t.text, None
    for m in _AT.finditer(text):
        a, b = m.span()
        host = _HOST.match(text, _SPACE.match(text, b).end())
        if not host:
            continue
        while a > done and text[a - 1].isspace():
            a -= 1
        turned = text[::-1] if turned is None else turned
        name = _LOCAL.match(turned, len(text) - a, len(text) - done)
        if not name:
            continue
        dots = [*_DOTS.finditer(host[0])]
        tops = [k for k, d in enumerate(dots) if _TOP.match(text, host.start() + d.end())]
        if not tops:
            continue
        dots = dots[: tops[-1] + 1]
        cuts = [0, *(d.end() for d in dots)]
        labels = [host[0][x:y] for x, y in zip(cuts, [*(d.start() for d in dots), cuts[-1] + len(_TOP.match(text, host.start() + cuts[-1])[0])])]
        if m[0].lower() == "at" and _prose(m[0], name[0][::-1], labels, [d[0] for d in dots]):
            continue
        start = len(text) - name.end()
        edits += [(start + d.start(), start + d.end(), ".") for d in _DOTS.finditer(text[start:a]) if d[0] != "."]
        if (a, host.start()) != m.span() or m[0] != "@":
            edits.append((a, host.start(), "@"))
        edits += [(host.start() + d.start(), host.start() + d.end(), ".") for d in dots if d[0] != "."]
        done = host.start() + cuts[-1] + len(labels[-1])
    return t.rewrite(edits)


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans), both by kind, then start."""
    base = base_spans(text)
    tape = Tape(text)
    if not text.isascii():
        tape = _forms(tape)
    tape = _addresses(_digits(tape))
    if tape.text == text:
        return base, base
    taken, added = bytearray(len(text)), []
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    for kind, a, b in base_spans(tape.text):
        s, e = tape.starts[a], tape.ends[b - 1]
        if 1 not in taken[s:e]:
            added.append((kind, s, e))
            taken[s:e] = b"\1" * (e - s)
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1]))


def _said(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans and all spans, for every row of docs."""

    def run(ids, values):
        out = []
        for t in values:
            base, spans = all_spans(t)
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            out.append((*n, hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), len(spans) - len(base)))
        return ids, *zip(*out)

    return map_batches(texts(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact_text(text: str) -> str:
    """Each span becomes <kind>; where spans of two kinds overlap, their union takes the name of the first."""
    spans = sorted(((a, b, k) for k, a, b in all_spans(text)[1]), key=lambda x: (x[0], -x[1]))
    out, pos, k = [], 0, 0
    while k < len(spans):
        a, b, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][1])
            k += 1
        out += [text[pos:a], f"<{kind}>"]
        pos = b
    return "".join(out) + text[pos:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with the same columns; personal data in its texts replaced, null texts left null."""

    @F.pandas_udf("string")
    def clean(values):
        return values.map(lambda t: None if t is None else redact_text(t))

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(docs.columns)
