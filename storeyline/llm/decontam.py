"""Benchmark items inside documents, by the q-gram lemma.

Texts and items are normalised: letters and digits lower-cased, every run of anything else one
space. An item of m characters may occur with up to e = m // ``per_error`` edits. By the q-gram
lemma such an occurrence shares at least m - q + 1 - q * e q-grams with the item, and all of them
lie on diagonals (text position - item position) that span at most e. Shared q-grams are counted in
diagonal bands that overlap by half, so one band holds them all; bands that reach the bound are
verified by banded alignment, the rest cannot hold an occurrence.

The items are broadcast in blocks of a bounded number of characters; a larger benchmark takes
further passes over the documents. The documents are not shuffled.

Defined results: null and empty texts and items match nothing; items of fewer than q normalised
characters must occur exactly, between word borders; where the bound would fall below 1, e is
lowered until it is 1. Items with a null id are found like others and reported with a null item_id,
equal texts among them once. Repeated rows each have their matches. Of overlapping matches of one item
the one of fewest edits is kept, then the first.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from storeyline.llm.common import held, positional
from storeyline.llm.textcodes import mixed

Q = 12
PER_ERROR = 20
#: Characters of items in one broadcast.
ITEM_CHARS = 8_000_000
_FILTER = 1 << 22


@cache
def _table() -> np.ndarray:
    table = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        if (c := chr(i)).isalnum():
            table[i] = ord(c.lower()[0])
    return table


def normalised(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, positions in the text) without leading space."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _table()[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes >= 1 << 16):
        out[i] = ord(chr(codes[i]).lower()[0]) if chr(codes[i]).isalnum() else 32
    keep = (out != 32) | np.concatenate(([False], out[:-1] != 32)) if len(out) else np.zeros(0, bool)
    at = np.flatnonzero(keep)
    out = out[at]
    if len(out) and out[-1] == 32:
        out, at = out[:-1], at[:-1]
    return out, at


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of codes[i : i + q] for each i."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    parts, size, now, done, out = [], 1, codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0, None
    while size <= q:  # hashes of 1, 2, 4, ... codes; those that make up q are joined
        if q & size:
            part = now[done : done + n]
            out = part.copy() if out is None else mixed(out) * np.uint64(0xD6E8FEB86659FD93) + part
            done += size
        if size * 2 <= q:
            now = mixed(now[:-size]) * np.uint64(0xC2B2AE3D27D4EB4F) + now[size:]
        size *= 2
    return mixed(out)


@dataclass
class Index:
    ids: list[int | None]
    items: list[np.ndarray]
    errors: np.ndarray
    bounds: np.ndarray  # shared q-grams needed
    grams: np.ndarray  # sorted distinct hashes
    starts: np.ndarray  # of each hash's postings
    item_of: np.ndarray
    pos_of: np.ndarray
    seen: np.ndarray  # _FILTER flags by a hash's high bits
    short: list[tuple[int | None, str]]


def index(items: list[tuple[int | None, str]], q: int = Q, per_error: int = PER_ERROR) -> Index:
    ids, kept, short = [], [], []
    for i, text in items:
        codes, _ = normalised(text)
        if len(codes) >= q:
            ids.append(i)
            kept.append(codes)
        elif len(codes):
            short.append((i, codes.tobytes().decode("utf-32-le", "surrogatepass")))
    size = np.array([len(c) for c in kept], np.int64)
    errors = np.maximum(0, np.minimum(size // per_error, (size - q) // q)) if len(size) else size
    hashes = [gram_hashes(c, q) for c in kept]
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    item_of = np.repeat(np.arange(len(kept)), [len(h) for h in hashes]) if kept else np.zeros(0, np.int64)
    pos_of = np.concatenate([np.arange(len(h)) for h in hashes]) if kept else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    grams, first = np.unique(flat[order], return_index=True)
    seen = np.zeros(_FILTER, bool)
    seen[(grams >> np.uint64(42)).astype(np.int64)] = True
    return Index(ids, kept, errors, size - q + 1 - q * errors, grams, np.append(first, len(flat)), item_of[order], pos_of[order], seen, short)


def align(item: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the item's best occurrence in ``text``, if within the limit.

    Rows are the item's characters, columns the diagonals; each cell keeps edits and start of the
    best alignment ending there. Only cells within the text's few diagonals exist: a band."""
    m, n = len(item), len(text)
    width = n - m + 2 * limit + 1  # diagonals -limit .. n - m + limit
    if width <= 0:
        return None
    diag = np.arange(width) - limit
    big = np.int64(1) << 40
    # edits in the high part, start in the low part: the minimum prefers few edits, then early starts
    unit = np.int64(1) << 32
    now = np.where((diag >= 0) & (diag <= n), np.maximum(diag, 0), big * 1024)
    step = np.arange(width) * unit
    for i in range(1, m + 1):
        j = diag + i  # text characters used after this row
        ok = (j >= 1) & (j <= n)
        same = np.zeros(width, bool)
        same[ok] = text[j[ok] - 1] == item[i - 1]
        new = np.where(ok, now + np.where(same, 0, unit), big * 1024)
        new[:-1] = np.minimum(new[:-1], now[1:] + unit)  # the item's character is missing in the text
        new[j < 0] = big * 1024
        new[j > n] = big * 1024
        new = np.minimum.accumulate(new - step) + step  # extra characters in the text
        new[(j < 0) | (j > n)] = big * 1024
        now = new
    best = int(np.argmin(now >> 32))
    edits, start = int(now[best] >> 32), int(now[best] & 0xFFFFFFFF)
    return (edits, start, int(diag[best]) + m) if edits <= limit else None


def find(texts: list[str | None], own: Index, q: int = Q) -> list[list[tuple[int | None, int, int, int]]]:
    """For each text (item, start, end, edits), in code points of the text."""
    out: list[list[tuple[int | None, int, int, int]]] = []
    for text in texts:
        found: list[tuple[int | None, int, int, int, object]] = []  # the last tells items without an id apart
        codes, at = normalised(text)
        flat = f" {codes.tobytes().decode('utf-32-le', 'surrogatepass')} " if own.short else ""
        for i, word in own.short:
            k = flat.find(f" {word} ")
            while k >= 0:
                found.append((i, int(at[k]), int(at[k + len(word) - 1]) + 1, 0, word if i is None else None))
                k = flat.find(f" {word} ", k + len(word) + 1)
        hashes = gram_hashes(codes, q)
        where = np.flatnonzero(own.seen[(hashes >> np.uint64(42)).astype(np.int64)]) if len(own.grams) else np.zeros(0, int)
        if len(where):
            k = np.minimum(np.searchsorted(own.grams, hashes[where]), len(own.grams) - 1)
            hit = own.grams[k] == hashes[where]
            where, k = where[hit], k[hit]
        if len(where):
            n = own.starts[k + 1] - own.starts[k]
            posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(own.starts[k], n)
            item, diagonal = own.item_of[posting], np.repeat(where, n) - own.pos_of[posting]
            half = own.errors[item] + 1
            band = diagonal // half + len(codes) + 1
            both = np.concatenate((band, band - 1)) + np.concatenate((item, item)) * np.int64(4 * len(codes) + (1 << 20))
            key, count = np.unique(both, return_counts=True)
            which, b = key // (4 * len(codes) + (1 << 20)), key % (4 * len(codes) + (1 << 20)) - len(codes) - 1
            for x, left in sorted(set(zip(which[count >= own.bounds[which]].tolist(), (b * (own.errors[which] + 1))[count >= own.bounds[which]].tolist(), strict=True))):
                e, m = int(own.errors[x]), len(own.items[x])
                lo, hi = max(0, left - e), min(len(codes), left + 2 * (e + 1) + m + e)
                if got := align(own.items[x], codes[lo:hi], e):
                    edits, s, t = got
                    if t > s:
                        found.append((own.ids[x], int(at[lo + s]), int(at[lo + t - 1]) + 1, edits, x if own.ids[x] is None else None))
        best: list[tuple[int | None, int, int, int]] = []
        taken: dict[tuple, list[tuple[int, int]]] = {}  # apart and in order
        for f in sorted(found, key=lambda f: (f[3], f[1], f[2])):
            spans = taken.setdefault((f[0], f[4]), [])
            after = bisect_left(spans, (f[1], f[2]))
            if (after == 0 or spans[after - 1][1] <= f[1]) and (after == len(spans) or f[2] <= spans[after][0]):
                spans.insert(after, (f[1], f[2]))
                best.append(f[:4])
        out.append(sorted(best, key=_nulls_last))
    return out


def _nulls_last(row: tuple) -> tuple:
    return row[0] is None, row[0] or 0, *row[1:]


def _blocks(benchmark: DataFrame, item_chars: int) -> Iterator:
    """Broadcasts of (item_id, text), each of a bounded number of characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    n = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-n // max(1, item_chars)))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield benchmark.sparkSession.sparkContext.broadcast(sorted({(r.item_id, r.text) for r in part.toLocalIterator()}, key=_nulls_last))


def contaminated(docs: DataFrame, text: Column, keys: list[Column], benchmark: DataFrame, item_chars: int = ITEM_CHARS) -> DataFrame:
    """``keys`` with item_id, start, end, edits: one row a match; documents without one have none."""
    source, fields = positional(docs, keys, text)
    n, schema = len(fields), StructType([*fields, *(StructField(c, LongType()) for c in ("item_id", "start", "end", "edits"))])
    names = schema.names
    out = None
    for shared in _blocks(benchmark, item_chars):

        def run(batches: Iterable[pa.RecordBatch], shared=shared, key=("decontam", uuid.uuid4().hex)) -> Iterator[pa.RecordBatch]:
            own = held(key, lambda: index(shared.value))
            for batch in batches:
                found = find(batch.column(n).to_pylist(), own)
                row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
                flat = [m for f in found for m in f]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(n)), *(pa.array([m[c] for m in flat], pa.int64()) for c in range(4))], names=names)

        here = source.mapInArrow(run, schema)
        out = here if out is None else out.unionByName(here)
    return out


def clean(docs: DataFrame, text: str, benchmark: DataFrame, item_chars: int = ITEM_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""
    at = docs.columns.index(text)
    for shared in _blocks(benchmark, item_chars):

        def run(batches: Iterable[pa.RecordBatch], shared=shared, key=("decontam", uuid.uuid4().hex)) -> Iterator[pa.RecordBatch]:
            own = held(key, lambda: index(shared.value))
            for batch in batches:
                yield batch.filter(pa.array([not f for f in find(batch.column(at).to_pylist(), own)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
