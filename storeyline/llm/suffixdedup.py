"""Repeated byte strings, found by a distributed merge sort of suffixes.

A byte goes if some string of ``length`` bytes that covers it starts anywhere else too. Sorting
every suffix is not needed: in each such string the least hash of its ``GRAM``-byte grams marks an
anchor, equal strings have equal anchors, so only suffixes at anchors are sorted (about one byte in
97). Strings of ``short`` bytes, which a passage of some 50 words reaches, are found on the way:
they are counted and stay. Around an anchor a string reaches at most so many bytes less a gram to the
left and so many to the right; that much is the anchor's context, clipped to its document.

1. Anchors with the hash of their gram and of their context are written. Grams that occur once
   cannot lie in a repeat.
2. Of each context two copies, if there are two, are read from their documents. Every task sorts its
   suffixes into runs, front-codes them (length shared with the one before, and the rest) and
   exchanges the runs by range of the gram's hash, the leading part of the sort key.
3. Each range merges its runs by a loser tree that keeps the common prefix of every loser with the
   last winner: of two candidates the one sharing more with it comes first, and only where both
   share the same is anything compared, from that length on. The tree gives the sorted order
   and the common prefixes (LCP).
4. Two anchors of a gram that share r bytes from the gram on and l bytes before it share a string of
   l + r bytes; if that reaches the length, those bytes of both are repeated. Right sides share
   what the LCP says, left sides are sorted in reverse for theirs. Every removal is decided by bytes
   that were compared here; a context with more than two copies goes as its two copies do, being
   told equal by a 128-bit digest, keyed afresh in each run.

A gram in more contexts than ``GROUP`` (the ends of a passage that everybody quotes) would be one
task's group. A string over the gram starts some d bytes before it; the range of d is halved, and a
half's contexts are grouped by all the bytes that its strings have in common: longer keys, smaller
groups, which are merged as above, or halved again. At a single d the key is the whole string.

Defined results: null and empty texts have no bytes; matches never cross documents; repeated rows
are separate documents; a null doc_id is a value like another.
"""

from __future__ import annotations

import hashlib
import pickle
import secrets
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeyline.llm.common import stored, written
from storeyline.llm.textcodes import _powers, mixed

LENGTH = 400
SHORT = 256
GRAM = 64
RUN = 20_000
#: Contexts of a gram, some 100 MB of a worker's memory, that one task may hold; larger groups are divided.
GROUP = 100_000
#: Up to this size a group's pairs are looked at one by one.
PAIRS = 200
#: Words that a counted passage exceeds.
WORDS = 50
SLICE = 1 << 20
#: A context's name, and how far repeats of either length reach around its anchor.
SAID = ["kh", "ch", "ci", "l", "r", "short_l", "short_r"]
_HALF = ["kh", "ch", "ci", "copies", "doc_id", "th", "pos", "deep", "size", "low", "high", "g", "g2"]
_HALF_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
_HALF_SCHEMA = "kh long, ch long, ci long, copies int, doc_id long, th long, pos int, deep boolean, size int, low int, high int, g long, g2 long"


def _least(h: np.ndarray, n: int, length: int, gram: int) -> np.ndarray:
    """The positions of the least hash in each window of ``length`` bytes."""
    w = length - gram + 1
    found = [np.zeros(0, np.int64)]
    for at in range(0, n - length + 1, SLICE - length):
        part = h[at : at + SLICE - gram + 1]
        if len(part) < w:
            break
        low = np.arange(len(part), dtype=np.uint64)
        key = np.full(-(-len(part) // w) * w, np.uint64(2**64 - 1))
        key[: len(part)] = (part & ~np.uint64(SLICE - 1)) | low
        block = key.reshape(-1, w)
        before = np.minimum.accumulate(block, axis=1).ravel()
        after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[: len(part) - w + 1], before[w - 1 : len(part)])
        least = least[np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))]
        found.append(np.unique((least & np.uint64(SLICE - 1)).astype(np.int64)) + at)
    return np.unique(np.concatenate(found))


def anchors(data: bytes, length: int = LENGTH, short: int = SHORT, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, whether the anchor is one of strings of ``length``) of one document."""
    n = len(data)
    if n < short:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    up, down = _powers(max(16, n.bit_length()))
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=total[1:])
    h = mixed((total[gram:] - total[: n - gram + 1]) * down[: n - gram + 1])
    pos = _least(h, n, short, gram)
    deep = np.isin(pos, _least(h, n, length, gram), assume_unique=True)
    return pos, mixed(h[pos] * np.uint64(0xD6E8FEB86659FD93)), deep  # least hashes are small ones: spread them again


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def front_coded(items: list[tuple[bytes, bytes, bytes, int]]) -> bytes:
    """A run of (key, name, reversed left side, copies), sorted, front-coded and
    packed, as the runs are most of what is exchanged; names have 24 bytes."""
    items.sort()
    shared, tails, last = [], [], b""
    for key, *_ in items:
        n = common(last, key, 0)
        shared.append(n)
        tails.append(key[n:])
        last = key
    pack = lambda parts: (np.array([len(p) for p in parts], "<u2").tobytes(), b"".join(parts))
    run = pickle.dumps((np.array(shared, "<u2").tobytes(), *pack(tails), *pack([x[2] for x in items]), b"".join(x[1] for x in items), bytes(min(2, x[3]) for x in items)))
    return len(run).to_bytes(8, "little") + pa.compress(run, codec="zstd", asbytes=True)


def decoded(run: bytes) -> Iterator[tuple[bytes, int, tuple[bytes, bytes, int]]]:
    """(key, common prefix with the key before, (name, left, copies)) in order."""
    plain = pa.decompress(run[8:], int.from_bytes(run[:8], "little"), codec="zstd", asbytes=True)
    shared, tail_n, tails, left_n, lefts, names, copies = pickle.loads(plain)
    key, t, s, at = b"", 0, 0, 0
    for n, a, b, m in zip(np.frombuffer(shared, "<u2").tolist(), np.frombuffer(tail_n, "<u2").tolist(), np.frombuffer(left_n, "<u2").tolist(), copies, strict=True):
        key = key[:n] + tails[t : t + a]
        yield key, n, (names[at : at + 24], lefts[s : s + b], m)
        t, s, at = t + a, s + b, at + 24


def merged(runs: list[Iterator[tuple[bytes, int, tuple]]]) -> Iterator[tuple[bytes, int, tuple]]:
    """One sorted sequence of (key, common prefix with the key before, rest), by a loser tree."""
    k = len(runs)
    heads: list = [next(r, None) for r in runs]
    size = 1
    while size < k:
        size *= 2
    heads += [None] * (size - k)
    loser, share = [0] * size, [0] * size  # of each inner node: the run that lost there, its common prefix with the winner

    def play(a: int, ha: int, b: int, hb: int) -> tuple[int, int, int, int]:
        """(winner, its common prefix with the last output, loser, its common prefix with the winner)."""
        if heads[a] is None or heads[b] is None:
            return (b, hb, a, 0) if heads[a] is None else (a, ha, b, 0)
        if ha != hb:  # sharing more with the last output means coming sooner
            return (a, ha, b, hb) if ha > hb else (b, hb, a, ha)
        x, y = heads[a][0], heads[b][0]
        n = common(x, y, ha)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            return a, ha, b, n
        return b, hb, a, n

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        a, ha = build(2 * node)
        b, hb = build(2 * node + 1)
        a, ha, loser[node], share[node] = play(a, ha, b, hb)
        return a, ha

    winner, h = build(1) if size > 1 else (0, 0)
    while heads[winner] is not None:
        key, _, rest = heads[winner]
        yield key, h, rest
        heads[winner] = next(runs[winner], None)
        h = heads[winner][1] if heads[winner] is not None else 0
        node = (winner + size) // 2
        while node:
            winner, h, loser[node], share[node] = play(winner, h, loser[node], share[node])
            node //= 2


def _between(shared: np.ndarray) -> np.ndarray:
    """[i, j]: the common prefix of the i-th and j-th of a sorted list, from those of neighbours."""
    n = len(shared)
    out = np.zeros((n, n), np.int64)
    for i in range(n - 1):
        out[i, i + 1 :] = out[i + 1 :, i] = np.minimum.accumulate(shared[i + 1 :])
    return out


def _group(right: np.ndarray, lefts: list[bytes], right_n: np.ndarray, lengths: tuple[int, ...], gram: int) -> np.ndarray:
    """(suffixes, 2 * lengths): for each length how far repeats reach to the left and right; -1 where there is
    none. ``right`` has the common prefix of each suffix with the one before, from the gram on."""
    n = len(lefts)
    out = np.full((n, 2 * len(lengths)), -1, np.int64)
    if n == 2:
        l, r = common(lefts[0], lefts[1], 0), int(right[1])
        for k, length in enumerate(lengths):
            if l + r >= length:
                out[:, 2 * k : 2 * k + 2] = l, r
        return out
    order = np.array(sorted(range(n), key=lefts.__getitem__))
    left = np.array([0, *(common(lefts[a], lefts[b], 0) for a, b in zip(order[:-1], order[1:], strict=True))], np.int64)
    if n <= PAIRS:
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        l, r = _between(left)[np.ix_(place, place)], _between(right)
        np.fill_diagonal(r, -(1 << 20))
        for k, length in enumerate(lengths):
            ok = l + r >= length
            out[:, 2 * k], out[:, 2 * k + 1] = np.where(ok, l, -1).max(1), np.where(ok, r, -1).max(1)
        return out
    left_n, place = np.array([len(x) for x in lefts]), np.empty(n, np.int64)
    for k, length in enumerate(lengths):
        for d in range(length - gram + 1):  # strings that start d bytes before the gram: pairs of intervals
            live = np.flatnonzero((left_n >= d) & (right_n >= length - d))
            if len(live) < 2:
                continue
            place[order] = np.cumsum(left < d)
            pair = np.cumsum(right < length - d)[live] * np.int64(n + 2) + place[live]
            by = np.argsort(pair, kind="stable")
            twin = pair[by][1:] == pair[by][:-1]
            hit = np.zeros(len(live), bool)
            hit[by[1:][twin]] = True
            hit[by[:-1][twin]] = True
            hit = live[hit]
            out[hit, 2 * k] = d
            out[hit, 2 * k + 1] = np.maximum(out[hit, 2 * k + 1], length - d)
    return out


def resolved(part: list[tuple[bytes, int, tuple[bytes, bytes, int]]], lengths: tuple[int, ...], gram: int) -> dict[bytes, np.ndarray]:
    """Name -> reaches as in ``_group``, of those in a repeat; ``part`` is what ``merged`` yields.

    Keys are 8 bytes that name the group and the suffix; common prefixes count those 8 bytes too."""
    starts = [0, *(i for i in range(1, len(part)) if part[i][1] < 8), len(part)]
    found: dict[bytes, np.ndarray] = {}

    def put(name: bytes, reach: np.ndarray) -> None:
        if reach.max() >= 0:
            found[name] = np.maximum(reach, found[name]) if name in found else reach

    for a, b in zip(starts[:-1], starts[1:], strict=True):
        for key, _, (name, left, copies) in part[a:b] if b > a else []:
            if copies > 1:  # the same row, twice in the table
                whole = len(left) + len(key) - 8
                put(name, np.array([x for length in lengths for x in ((len(left), len(key) - 8) if whole >= length else (-1, -1))]))
        if b - a > 1:
            shared = np.array([x[1] - 8 for x in part[a:b]], np.int64)
            reach = _group(shared, [x[2][1] for x in part[a:b]], np.array([len(x[0]) - 8 for x in part[a:b]]), lengths, gram)
            for i in np.flatnonzero(reach.max(1) >= 0):
                put(part[a + i][2][0], reach[i])
    return found


def _text_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _joined(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _again(key: str) -> Column:
    """A join key that makes Spark deal rows anew, so that it may split those of a frequent one."""
    return F.xxhash64(F.lit(3), key)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, short: int = SHORT, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; n_repeated, the bytes in repeated strings of ``short``
    bytes, which stay unless the others go; n_passages, the runs of those with over ``WORDS`` words; on
    request spans and kept (bytes)."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    lengths, secret = (length, short), secrets.token_bytes(16)
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def around(data: bytes, pos: int, deep: bool) -> tuple[bytes, bytes]:
        size = length if deep else short
        return data[max(0, pos - size + gram) : pos], data[pos : pos + size]

    def digest(*parts: bytes) -> bytes:
        h = hashlib.blake2b(key=secret, digest_size=16)
        for p in parts:
            h.update(len(p).to_bytes(4, "little"))
            h.update(p)
        return h.digest()

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_text_bytes(t) for t in batch.column(1).to_pylist()]
            found = [anchors(t, length, short, gram) for t in texts]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), pa.int64())
            pos, kh, deep = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
            ch = [digest(*around(t, p, d)) for t, f in zip(texts, found, strict=True) for p, d in zip(f[0].tolist(), f[2].tolist(), strict=True)]
            ch = np.frombuffer(b"".join(ch), "<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), pa.array(pos.astype(np.int32)), pa.array(deep.astype(bool)), pa.array(kh.astype(np.uint64).view(np.int64)), pa.array(ch[::2]), pa.array(ch[1::2])], names=["doc_id", "th", "pos", "deep", "kh", "ch", "ci"])

    marked, forget = stored(source.mapInArrow(mark, "doc_id long, th long, pos int, deep boolean, kh long, ch long, ci long"))
    often = marked.groupBy("kh").agg(F.count("*").alias("n")).where("n > 1").select(F.col("kh").alias("k"))
    live = written(marked.join(often, (_again("kh") == _again("k")) & (F.col("kh") == F.col("k"))).drop("k"))
    forget()
    place = F.struct("doc_id", "th", "pos", "deep")
    kinds = live.groupBy("kh", "ch", "ci").agg(F.count("*").alias("m"), F.min(place).alias("one"), F.max(place).alias("two"))
    kinds, forget = stored(kinds)

    def items(of: DataFrame, *more: str) -> DataFrame:
        """A row for each of the one or two copies of a context, with where it is and whether it is one row's twice."""
        copies = F.when((F.col("m") > 1) & F.col("one").eqNullSafe(F.col("two")), 2).otherwise(1).alias("copies")
        both = F.when((F.col("m") > 1) & ~F.col("one").eqNullSafe(F.col("two")), F.array("one", "two")).otherwise(F.array("one"))
        return of.select("kh", "ch", "ci", *more, copies, F.explode(both).alias("at")).select("kh", "ch", "ci", *more, "copies", "at.*")

    def read(of: DataFrame, run, schema: str) -> DataFrame:
        """``run`` over (bytes, wanted contexts) of the documents that hold the contexts ``of``."""
        wanted = [c for c in of.columns if c not in ("doc_id", "th")]
        asked = of.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list(F.struct(*wanted)).alias("wanted"))
        met = source.join(asked.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("t"))).select("doc_id", "th", "text", "wanted")

        def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple[bytes, list[dict], tuple]]:
                seen = set()  # equal rows of the table are one here
                for batch in batches:
                    for i, row in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                        if row not in seen:
                            seen.add(row)
                            yield _text_bytes(batch.column(2)[i].as_py()), batch.column(3)[i].as_py(), row

            yield from run(rows())

        return met.mapInArrow(once, schema)

    def runs(rows: Iterator[tuple[bytes, list[dict], tuple]]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            parts: dict[int, list] = {}
            for x in held:
                parts.setdefault((int.from_bytes(x[0][:4], "big") * ranges) >> 32, []).append(x)
            return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([front_coded(v) for v in parts.values()], pa.binary())], names=["range", "run"])

        held: list[tuple[bytes, bytes, bytes, int]] = []
        for data, wanted, _ in rows:
            for w in wanted:
                left, right = around(data, w["pos"], w["deep"])
                held.append((struct.pack(">q", w["group"]) + right, struct.pack("<3q", w["kh"], w["ch"], w["ci"]), left[::-1], w["copies"]))
            if len(held) >= RUN:
                yield out(held)
                held = []
        if held:
            yield out(held)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(part: list[tuple[bytes, int, tuple]]) -> pa.RecordBatch:
            found = resolved(part, lengths, gram)
            names = np.frombuffer(b"".join(found), "<i8").reshape(-1, 3)
            reach = np.array(list(found.values()), np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays([*(pa.array(names[:, i]) for i in range(3)), *(pa.array(reach[:, i]) for i in range(4))], names=SAID)

        def by_range() -> Iterator[list[bytes]]:
            last, held = None, []
            for batch in batches:
                for r, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if r != last and held:
                        yield held
                        held = []
                    last = r
                    held.append(run)
            if held:
                yield held

        for held in by_range():
            part: list[tuple[bytes, int, tuple]] = []
            for item in merged([decoded(r) for r in held]):
                if item[1] < 8 and len(part) >= RUN:  # another group: no interval crosses it
                    yield solved(part)
                    part = []
                part.append(item)
            if part:
                yield solved(part)

    def halved(rows: Iterator[tuple[bytes, list[dict], tuple]]) -> Iterator[pa.RecordBatch]:
        """Contexts of too large groups, by the bytes that the strings of each half of the range have in common."""
        for data, wanted, (doc_id, th) in rows:
            out = []
            for w in wanted:
                size, low, high, pos = w["size"], w["low"], w["high"], w["pos"]
                mid = (low + high) // 2
                for a, b in ((low, mid), (mid + 1, high)):
                    if a <= b and pos >= a and pos + size - b <= len(data) and (w["deep"] or size == short):
                        g = struct.unpack("<2q", digest(struct.pack("<4q", w["kh"], size, a, b), data[pos - a : pos + size - b]))
                        out.append((w["kh"], w["ch"], w["ci"], w["copies"], doc_id, th, pos, w["deep"], size, a, b, *g))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _HALF_TYPES, strict=True)], names=_HALF)

    of_gram = kinds.groupBy("kh").agg(F.sum(F.least("m", F.lit(2))).alias("n"))
    large = written(of_gram.where(F.col("n") > GROUP).select(F.col("kh").alias("k")))
    by_gram = items(kinds)
    done: list[DataFrame] = []
    if large.isEmpty():
        fit = by_gram.withColumn("group", F.col("kh"))
    else:
        is_large = (_again("kh") == _again("k")) & (F.col("kh") == F.col("k"))
        fit = by_gram.join(large, is_large, "left_anti").withColumn("group", F.col("kh"))
        ask = by_gram.join(large, is_large, "left_semi").withColumn("size", F.explode(F.array(*map(F.lit, lengths)))).withColumns({"low": F.lit(0), "high": F.col("size") - gram})
        while True:
            level = written(read(ask, halved, _HALF_SCHEMA))
            sizes = level.groupBy("g", "g2").agg(F.count("*").alias("n"), F.max("copies").alias("c")).where("n > 1 or c > 1").select(F.col("g").alias("a"), F.col("g2").alias("b"), "n")
            level = written(level.join(sizes, (_again("g") == _again("a")) & (F.col("g") == F.col("a")) & (F.col("g2") == F.col("b"))))
            small = F.col("n") <= GROUP
            fit = fit.unionByName(level.where(small).select("kh", "ch", "ci", "copies", "doc_id", "th", "pos", "deep", F.col("g").alias("group")))
            # at a single place all of a group are one string
            reach = [F.when(F.col("size") == size, c).otherwise(F.lit(-1)).cast("long") for size in lengths for c in (F.col("low"), F.col("size") - F.col("low"))]
            done.append(level.where(~small & (F.col("low") == F.col("high"))).select("kh", "ch", "ci", *(c.alias(n) for c, n in zip(reach, SAID[3:], strict=True))))
            ask = level.where(~small & (F.col("low") < F.col("high"))).select("kh", "ch", "ci", "copies", "doc_id", "th", "pos", "deep", "size", "low", "high")
            if ask.isEmpty():
                break
        fit = written(fit.distinct())
    ranges = max(deal, -(-fit.count() // (2 * RUN)))
    said = read(fit, runs, "range long, run binary").repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(merge, ", ".join(f"{n} long" for n in SAID))
    for more in done:
        said = said.unionByName(more)
    said = written(said.groupBy(*SAID[:3]).agg(*(F.max(n).alias(n) for n in SAID[3:])))
    forget()
    place = F.struct(*(F.when(F.col(n) >= 0, F.col("pos") + (F.col(n) if i % 2 else -F.col(n))).cast("long").alias(n) for i, n in enumerate(SAID[3:])))
    cover = live.join(said, SAID[:3]).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), place.alias("at"))
    cover = cover.distinct().groupBy("d", "t").agg(F.collect_list("at").alias("cover"))
    final = source.join(cover.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("t")), "left").select("doc_id", "text", "cover")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, n_passages long" + ", spans array<struct<s:long,e:long>>, kept binary" * with_text

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kepts = [], []
            for text, cover in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = _text_bytes(text)
                spans = _joined((c["l"], c["r"]) for c in cover or [] if c["l"] is not None)
                others = _joined((c["short_l"], c["short_r"]) for c in cover or [] if c["short_l"] is not None)
                kept, at = [], 0
                for s, e in spans:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                passages = sum(len(data[s:e].split()) > WORDS for s, e in others)
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), sum(e - s for s, e in others), passages, [{"s": s, "e": e} for s, e in spans]))
                kepts.append(kept)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))][: 6 + with_text]
            columns = [batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), *[pa.array(kepts, pa.binary())] * with_text]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "n_passages", *["spans", "kept"] * with_text])

    return final.mapInArrow(cut, schema)
