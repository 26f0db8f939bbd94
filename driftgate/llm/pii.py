"""Personal data in whole texts, plain and disguised, with spans in the source text.

Plain spans come from four fixed patterns, leftmost and non-overlapping per kind. Disguised ones come from a
transducer that rewrites a text (homoglyphs, invisible characters, spelled digits, bracketed or spelled at and dot) and
keeps for each written character the range of source characters it came from. The same patterns run on the rewritten
text, and matches go back through those ranges. Plain spans stay as they are; a disguised span counts beside them if it
reaches beyond the plain ones it touches, and is left out otherwise.

Spans count code points, end exclusive. Texts are searched one by one, whole, in time linear in their length.

Defined cases: a null text is empty and has no spans; repeated rows are searched alike; further columns are carried,
and those named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from driftgate.llm.text import slices

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
STRETCH = 256


def _before(text: str, at: int, floor: int) -> int:
    """Where the run of local-part characters that ends at ``at`` begins, not before ``floor``."""
    while at > floor:
        low = max(floor, at - STRETCH)
        run = _LOCAL.search(text, low, at) if low else _LOCAL.search(text[:at])
        if run is None:
            return at
        if run.start() > low:
            return run.start()
        at = low
    return at


def emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        end = None
        if (m := _DOMAIN.match(text, at)) and (begin := _before(text, at, floor)) < at:
            end = floor = m.end()
            yield begin, end
        at = text.find("@", end or at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def addresses(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while run := _DIGITS.search(text, at):  # a match begins where a run of digits does
        at = run.end()
        if text[at : at + 1] == "." and (m := _IP.match(text, run.start())):
            at = m.end()
            if all(map(_small, m.group().split("."))):
                yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                yield m.span()


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans of all kinds as (start, end, kind)."""
    return [(s, e, kind) for kind in KINDS for s, e in FINDERS[kind](text)]


# -- the transducer

# fixed values: letters of other scripts that look like Latin ones
_LOOKS = dict(
    zip(
        "аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧο",
        "aeopcyxijsdhqwABEKMHOPCTYXIJSABEZHIKMNOPTYXo",
        strict=True,
    )
)
# fixed values: characters without a shape of their own
_INVISIBLE = "­​‌‍⁠﻿"
# fixed values: English digit words
_SPELLED = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())}
_WORDS = "|".join(_SPELLED)
_AT = re.compile(r"[ \t]*[\[({<][ \t]*at[ \t]*[\])}>][ \t]*", re.I)
_DOT = re.compile(r"[ \t]*[\[({<][ \t]*(?:dot|point)[ \t]*[\])}>][ \t]*", re.I)
# "name at host dot com": bare words count only together
_BARE = re.compile(r"(?<![\w.%+-])([\w.%+-]{1,64})([ \t]+at[ \t]+)([\w-]{1,64})((?:[ \t]+dot[ \t]+[\w-]{1,64})+)(?!\w)", re.I)
_BRACKETED = re.compile(r"[\[({<][ \t]*(?:at|dot|point)[ \t]*[\])}>]")
_BETWEEN = {w: re.compile(rf"[ \t]{w}[ \t]") for w in ("at", "dot")}
_BARE_DOT = re.compile(r"[ \t]+dot[ \t]+", re.I)
_SAID = re.compile(
    rf"(?<!\w)(?:plus[ \t]+)?(?:{_WORDS}|[0-9]+)(?:[ \t,-]+(?:dot[ \t]+)?(?:{_WORDS}|[0-9]+))*(?!\w)", re.I
)
_SAID_PART = re.compile(rf"(plus)[ \t]+|({_WORDS})|([0-9])|[ \t,-]+(dot)[ \t]+|([ \t,-]+)", re.I)


@cache
def _fold_table() -> dict[int, str]:
    """Single characters that stand for an ASCII one: compatibility forms (full width, styled, circled), lookalikes."""
    table = {ord(c): to for c, to in _LOOKS.items()} | dict.fromkeys(map(ord, _INVISIBLE), "")
    for code in (*range(0x2070, 0x209D), *range(0x2460, 0x24EB), *range(0xFE50, 0xFE70), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain.isascii():
            table[code] = plain
    for code in (*range(0x0660, 0x066A), *range(0x06F0, 0x06FA), *range(0x0966, 0x0970)):
        table[code] = str(unicodedata.digit(chr(code)))
    return table


# the blocks that hold all keys of the table; a few wide ranges search much faster than a long list
_FOLDABLE = re.compile("[\u00ad\u0391-\u03bf\u0405-\u051d\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u200b-\u200d\u2060-\u24ea\ufe50-\uff5e\U0001d400-\U0001d7ff]")


class Rewrite:
    """A text under rewriting; ``begin[i]:end[i]`` is the source range of written character ``i``."""

    def __init__(self, text: str):
        self.text = text
        self.begin = np.arange(len(text))
        self.end = self.begin + 1

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges, given in order and apart; each written character covers the whole range it replaces."""
        if not edits:
            return
        text, begin, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            begin += [self.begin[at:a], np.full(len(new), self.begin[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.begin, self.end = np.concatenate([*begin, self.begin[at:]]), np.concatenate([*end, self.end[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.begin[a]), int(self.end[b - 1])


def _fold(t: Rewrite) -> None:
    table = _fold_table()
    found = _FOLDABLE.finditer(t.text)
    t.edit([(m.start(), m.end(), table[ord(m.group())]) for m in found if ord(m.group()) in table])


def _signs(t: Rewrite) -> None:
    """Bracketed and, in a full address, bare at and dot."""
    for pattern, sign in ((_AT, "@"), (_DOT, ".")):
        t.edit([(m.start(), m.end(), sign) for m in pattern.finditer(t.text)])
    edits = []
    for m in _BARE.finditer(t.text):
        edits.append((*m.span(2), "@"))
        edits += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(t.text, *m.span(4))]
    t.edit(edits)


def _digits(t: Rewrite) -> None:
    """Runs of spelled digits; plain digits may stand between, bare numbers alone are left as they are.

    A run with fewer than four spelled digits is rewritten if all of it then is personal data and nothing in it was.
    """
    edits = []
    for run in _SAID.finditer(t.text):
        parts = list(_SAID_PART.finditer(t.text, *run.span()))
        spelled = sum(p.group(2) is not None for p in parts)
        if not spelled:
            continue
        own = []
        for p in parts:
            new = "+" if p.group(1) else _SPELLED[p.group(2).lower()] if p.group(2) else "." if p.group(4) else None
            if new is None and p.group(5):
                new = ""
            if new is not None:
                own.append((*p.span(), new))
        if spelled < 4:
            # a plus sign before the run is part of it
            a, b = run.start() - (t.text[: run.start()][-1:] == "+"), run.end()
            part = Rewrite(t.text[a:b])
            part.edit([(x - a, y - a, new) for x, y, new in own])
            if find(t.text[a:b]) or not any(s <= 0 and e >= len(part.text) for s, e, _ in find(part.text)):
                continue
        edits += own
    t.edit(edits)


def _disguised(text: str) -> bool:
    if not text.isascii() and _FOLDABLE.search(text):
        return True
    low = text.lower()
    if _BRACKETED.search(low) or (_BETWEEN["dot"].search(low) and _BETWEEN["at"].search(low)):
        return True
    n = sum(low.count(w) for w in _SPELLED)
    return n >= 4 or (n > 0 and re.search("[0-9]", low) is not None)  # fewer make a number only with plain ones


def find_disguised(text: str) -> list[tuple[int, int, str]]:
    """Spans, in the source text, of what only shows after rewriting."""
    if not _disguised(text):
        return []
    t = Rewrite(text)
    _fold(t)
    _signs(t)
    _digits(t)
    if t.text == text:
        return []
    return [(*t.source(s, e), kind) for s, e, kind in find(t.text)]


def find_all(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Plain spans, and plain and disguised ones together; both by start, then kind as listed."""
    base = find(text)
    rank = {kind: i for i, kind in enumerate(KINDS)}
    more = []
    if extra := find_disguised(text):
        for kind in KINDS:
            own = sorted((s, e) for s, e, k in base if k == kind)
            begins = [s for s, _ in own]
            for s, e, k in extra:
                if k == kind:
                    at = int(np.searchsorted(begins, s, "right")) if own else 0  # own spans are apart: only the last one up to s can hold it
                    if not (at and own[at - 1][1] >= e):
                        more.append((s, e, k))
    order = lambda x: (x[0], rank[x[2]], x[1])
    return sorted(base, key=order), sorted(base + more, key=order)


def spell(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in found)


def mask(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for s, e, kind in found:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def annotate(docs: DataFrame, masked: bool = False) -> DataFrame:
    """The documents with ``n_email, n_ip, n_card, n_phone`` (of all spans), ``base_sha256`` and ``spans``.

    With ``masked`` the text itself is replaced by its masked form.
    """
    added = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    kept = docs.select([c for c in docs.columns if c not in added])
    place = kept.columns.index("text")
    schema = StructType(list(kept.schema))
    for n in added:
        schema = schema.add(n, "long" if n.startswith("n_") else "string")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            columns, counts, shas, spans, new = list(batch.columns), [], [], [], []
            for text in texts:
                base, found = find_all(text or "")
                counts.append([sum(k == kind for _, _, k in found) for kind in KINDS])
                shas.append(hashlib.sha256(spell(base).encode()).hexdigest())
                spans.append(spell(found))
                new.append(mask(text, found) if found else text)
            if masked:
                columns[place] = pa.array(new, columns[place].type)
            numbers = np.array(counts, np.int64).reshape(-1, len(KINDS))
            columns += [pa.array(numbers[:, i]) for i in range(len(KINDS))]
            columns += [pa.array(shas, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(apply, schema)
