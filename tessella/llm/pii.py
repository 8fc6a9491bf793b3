"""Personal data by offset-preserving deobfuscation.

Detectors run on the raw text (base spans) and again on a normalised text. Two transducers make
that text: one folds homoglyphs and drops invisible characters, one rewrites spelled digits and
at/dot disguises. Each normalised character carries the source interval it came from, so a match
is mapped back to source code points. Tasks see one text at a time; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The base patterns of the query's contract. Lookbehinds and possessive loops only
# stop the engine from trying again inside a run in which no match can begin.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters of other scripts that look like ASCII ones, and invisible characters.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁɡһӏѵԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρіι", "ABESIJKMHOPCTYXaesijopcyxdghlvqwABEZHIKMNOPTYXovpii", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
# Digit names in the corpus languages, and ways to write @ and a dot.
DIGITS = {
    "0": "zero oh null cero zéro",
    "1": "one eins uno un",
    "2": "two zwei zwo dos deux",
    "3": "three drei tres trois",
    "4": "four vier cuatro quatre",
    "5": "five fünf cinco cinq",
    "6": "six sechs seis",
    "7": "seven sieben siete sept",
    "8": "eight acht ocho huit",
    "9": "nine neun nueve neuf",
}
AT_WORDS, DOT_WORDS = "at|arroba|ät|arobase", "dot|punkt|punto|point"
# Country domains; other top-level domains have three letters or more, so a two-letter word like "on" is none.
COUNTRIES = (
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz "
    "de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp "
    "ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz "
    "om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz "
    "ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
)
TLD = rf"(?:[A-Za-z]{{3,}}|xn--[A-Za-z0-9-]+|{COUNTRIES.replace(' ', '|')})"

DIGIT_OF = {w: d for d, words in DIGITS.items() for w in words.split()}
_NUMBER = "|".join(sorted(DIGIT_OF, key=len, reverse=True))
_OPEN, _CLOSE = r"\x20*[\(\[\{<]\x20*", r"\x20*[\)\]\}>]\x20*"
_BRACKET = re.compile(rf"{_OPEN}(?:(?P<at>{AT_WORDS}|@)|(?:{DOT_WORDS}|\.)){_CLOSE}", re.I)
_HINT = re.compile(rf"[\(\[\{{<]\x20*(?:{AT_WORDS}|{DOT_WORDS}|@|\.)\x20*[\)\]\}}>]", re.I)
_DOT = rf"\x20(?:{DOT_WORDS})\x20"
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]+"
_PLAIN_AT = rf"\x20(?P<at>{AT_WORDS})\x20{_LABEL}(?:(?:{_DOT}|\.){_LABEL})*(?:{_DOT}|\.){TLD}(?![A-Za-z0-9])"
_NOT_AFTER_DOT = "".join(rf"(?<!\x20{w}\x20)" for w in DOT_WORDS.split("|"))  # a chain of dot words is tried from its first word only
_PLAIN = re.compile(rf"(?<![A-Za-z0-9._%+-]){_NOT_AFTER_DOT}{_LOCAL}(?:{_DOT}{_LOCAL})*{_PLAIN_AT}", re.I)
_PLAIN_HINT = re.compile(_PLAIN_AT, re.I)
_PLAIN_DOT = re.compile(_DOT, re.I)
_DIGIT = rf"(?:{_NUMBER}|[0-9])"
_GROUP = rf"{_DIGIT}(?:[\x20,-]*{_DIGIT})*"
# Seven digits or more, or four groups of digits or more between dot words.
_SAID = re.compile(rf"(?<!\w)(?:(?:plus[\x20-]+)?(?:{_DIGIT}[\x20,-]*(?:(?:{DOT_WORDS})\x20+)?){{6,}}{_DIGIT}|{_GROUP}(?:[\x20,-]*(?:{DOT_WORDS})\x20+{_GROUP}){{3,}})(?!\w)", re.I)
_SAID_PART = re.compile(rf"(?P<plus>plus)|(?P<num>{_NUMBER}|[0-9])|(?P<dot>{DOT_WORDS})", re.I)


# A lower-case letter or digit as it is, and by that which pairs of them begin a spelled number, "plus" or a digit.
_LOWER = np.zeros(0x181, np.uint8)
_LOWER[:128] = [ord(chr(c).lower()) for c in range(128)]
_LOWER[128:] = 1  # letters that a pattern without case may take for others: never ruled out
_BEGINS = np.zeros((128, 128), bool)
_BEGINS[[*range(48, 58), 1]] = True
for _word in [*DIGIT_OF, "plus"]:
    _BEGINS[ord(_word[0]), [ord(_word[1])] if _word[1] < "\x80" else []] = True
    _BEGINS[ord(_word[0]), 1] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base detectors, unsorted."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append((begin, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


@lru_cache(maxsize=65536)
def _fold(c: str) -> str:
    """ASCII character that `c` stands for; '' if invisible; `c` itself otherwise."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and " " < wide <= "~" else c


class Origins:
    """Where the characters of a rewritten text come from: its edits only, found by bisection."""

    def __init__(self) -> None:
        self.begin, self.end, self.source = [], [], []

    def add(self, begin: int, end: int, source: tuple[int, int]) -> None:
        """Rewritten characters begin:end (one or none) stand for the source interval."""
        self.begin.append(begin)
        self.end.append(end)
        self.source.append(source)

    def interval(self, at: int) -> tuple[int, int]:
        """The source interval behind the rewritten character `at`."""
        k = bisect_right(self.begin, at) - 1
        if k < 0:
            return at, at + 1
        if at < self.end[k]:
            return self.source[k]
        shift = self.source[k][1] - self.end[k]
        return at + shift, at + shift + 1


def fold(text: str) -> tuple[str, Origins | None]:
    """Homoglyph transducer: folded text and the origins of its characters (None: unchanged)."""
    table = {ord(c): _fold(c) for c in set(text) if c > "\x7f" and _fold(c) != c}
    if not table:
        return text, None
    origins = Origins()
    gone = [c for c, new in table.items() if not new]
    if gone:
        for n, m in enumerate(re.finditer("[" + "".join(map(re.escape, map(chr, gone))) + "]", text)):
            origins.add(m.start() - n, m.start() - n, (m.start(), m.end()))
    return text.translate(table), origins


def word_starts(text: str, piece: int = 1 << 18) -> Iterator[int]:
    """Positions at which a spelled number may begin: no word character before, then two letters or a digit that begin one."""
    for base in range(0, len(text), piece):
        points = np.frombuffer(text[base : base + piece + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        low = _LOWER[np.minimum(points, len(_LOWER) - 1)]
        for i in np.flatnonzero(_BEGINS[low, np.append(low[1:], np.uint8(0))][:piece]).tolist():
            before = text[base + i - 1] if base + i else " "
            if not (before.isalnum() or before == "_"):
                yield base + i


def said(text: str) -> Iterator[re.Match]:
    """The matches of _SAID, tried only where one can begin."""
    done = 0
    for i in word_starts(text):
        if i >= done and (m := _SAID.match(text, i)):
            yield m
            done = m.end()


def rewrite(text: str) -> tuple[str, Origins | None]:
    """Disguise transducer: rewritten text and the origins of its characters (None: unchanged)."""
    edits: list[tuple[int, int, str]] = []
    if _HINT.search(text):
        edits += [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKET.finditer(text)]
    if _PLAIN_HINT.search(text):
        for m in _PLAIN.finditer(text):
            edits.append((m.start("at") - 1, m.end("at") + 1, "@"))
            for begin, end in ((m.start(), m.start("at") - 1), (m.end("at") + 1, m.end())):
                edits += [(d.start(), d.end(), ".") for d in _PLAIN_DOT.finditer(text, begin, end)]
    for m in said(text):
        parts = list(_SAID_PART.finditer(text, m.start(), m.end()))
        if all(p["num"] and p[0].isdigit() for p in parts):  # no word: nothing is disguised
            continue
        for p, following in zip(parts, [*parts[1:], None], strict=True):
            new = "+" if p["plus"] else "." if p["dot"] else DIGIT_OF.get(p[0].lower(), p[0])
            edits.append((p.start(), following.start() if following else p.end(), new))
    if not edits:
        return text, None
    parts, origins, at, length = [], Origins(), 0, 0
    for begin, end, new in sorted(edits):
        if begin < at:
            continue
        parts += [text[at:begin], new]
        length += begin - at + 1
        origins.add(length - 1, length, (begin, end))
        at = end
    return "".join(parts) + text[at:], origins


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each sorted by start then kind."""
    base = sorted(detect(text))
    folded, source = (text, None) if text.isascii() else fold(text)
    plain, origin = rewrite(folded)
    if source is None and origin is None:
        return base, base
    spans = set(base)
    for a, kind, b in detect(plain):
        for origins in (origin, source):
            if origins is not None:
                a, b = origins.interval(a)[0], origins.interval(b - 1)[1]
        if not any(k == kind and x < b and a < y for x, k, y in base):
            spans.add((a, kind, b))
    return base, sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, shas, every = [[], [], [], []], [], []
        for text in batch.column(1):
            base, spans = scan(text.as_py() or "")
            for k in range(4):
                counts[k].append(sum(s[1] == k for s in base))
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
            every.append(joined(spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(every, pa.string())],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row per input row.

    Counts and base_sha256 cover the raw text; spans also has the disguised identifiers, in
    source code points, where no base span of the kind overlaps. A null text is empty and has
    no spans. Spans that start together go in the order of KINDS. Texts are scanned whole,
    however long. Repeated rows are reported each, also with equal or null ids; other columns
    are not read and may have any name. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan_batches, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
