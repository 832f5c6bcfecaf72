"""Personal data, found by anchors and grown by local parsers.

One Aho-Corasick automaton passes over a text and reports anchors: at-signs, plus signs, digits,
scheme marks and identifier cues. At each anchor a small parser expands to the left and right as
far as its grammar reaches and validates what it has (label structure, octet range, Luhn, length,
mod 97). Nothing else of the text is parsed. Matches of one kind never overlap: a parser starts
where the last match of its kind ended, whether that one was valid or dropped.

Defined results: a null text is empty; rows keep their multiplicity; other columns are untouched, and
the caller names the new ones, so that none clashes.
Spans are (kind, start, end) in code points, the end exclusive, by kind as in ``KINDS``, then start.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from storeyline.llm.common import positional

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "secret")
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_USER_URL = re.compile(r"[^\s/@\"'<>]+@[^\s\"'<>]+")
_IBAN = re.compile(r"[\s:=#]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_VALUE = re.compile(r"\"?'?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_\-./+=]{12,})")
_DIGITS = frozenset("0123456789")
_SECRET_CUES = ("token", "api_key", "apikey", "secret", "password", "passwd", "access_key")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


@cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in _DIGITS:
        found.add_word(c, ("digit", 1))
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), *((w, "iban") for w in ("IBAN", "iban", "Iban")), *((v, "secret") for w in _SECRET_CUES for v in (w, w.capitalize(), w.upper()))):
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of one text."""
    if not text:
        return []
    found: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, kept or dropped

    def put(kind: str, start: int, end: int, valid: bool = True) -> None:
        done[kind] = end
        if valid:
            found[kind].append((kind, start, end))

    before = -2  # the last digit anchor
    for at, (kind, size) in automaton().iter(text):
        if kind == "digit":
            if at == before + 1:
                before = at
                continue
            before = at
            if at >= done["ip"] and (m := _IP.match(text, at)):
                put("ip", at, m.end(), all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.groups()))
            if at >= done["card"] and (m := _CARD.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                put("card", at, m.end(), 16 <= len(digits) <= 19 and _luhn(digits))
            if at >= done["ssn"] and (not at or text[at - 1] != "-") and (m := _SSN.match(text, at)):
                put("ssn", at, m.end(), m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000")
        elif kind == "at":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                put("email", start, m.end())
        elif kind == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                put("phone", at, m.end(), 8 <= sum(c in _DIGITS for c in m[0]) <= 15)
        elif kind == "scheme":
            start = at - 2
            if m := _SCHEME.search(text[max(done["url"], start - 32) : start]):
                start -= len(m[0])
                if rest := _USER_URL.match(text, at + 1):
                    put("url", start, rest.end())
        elif kind == "iban":
            if at >= done["iban"] and (m := _IBAN.match(text, at + 1)):
                value = m[1].replace(" ", "")
                put("iban", m.start(1), m.end(1), 15 <= len(value) <= 34 and _mod97(value))
        elif at >= done["secret"] and (m := _VALUE.match(text, at + 1)):
            put("secret", m.start(1), m.end(1), any(c in _DIGITS for c in m[1]) and any(c.isalpha() for c in m[1]))
    return [s for kind in KINDS for s in found[kind]]


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    if text is None or not spans:
        return text
    out, at, open_ = [], 0, None
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if open_ and start < open_[1]:
            open_[1] = max(open_[1], end)
            continue
        if open_:
            at = open_[1]
        out += [text[at:start], f"[{kind.upper()}]"]
        open_ = [start, end]
    return "".join(out) + text[open_[1] :]


def personal_data(df: DataFrame, text: Column, keys: list[Column], redact: bool = False, names: tuple[str, str] = ("spans", "redacted")) -> DataFrame:
    """``keys`` with spans and, on request, the redacted text (null texts stay null) under ``names``. One
    pass, no shuffle; memory is one Arrow batch."""
    source, fields = positional(df, keys, text)
    n, schema = len(fields), StructType([*fields, StructField(names[0], SPANS), *[StructField(names[1], StringType())] * redact])
    every = schema.names
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n).to_pylist()
            spans = [find_spans(t) for t in texts]
            columns = [*(batch.column(i) for i in range(n)), pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], kind)]
            if redact:
                columns.append(pa.array([redacted(t, x) for t, x in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=every)

    return source.mapInArrow(run, schema)
