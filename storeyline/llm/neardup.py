"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct shingles of ``width`` words (words lower-cased in A-Z, split at
ASCII white space); with fewer words, the whole sequence is its one shingle. Equal sets form one
class. Each class has a signature of ``HASHES`` symbols of 16 bits. Two sets at the threshold t
differ in about HASHES * (1 - t) symbols; ``distance`` adds four standard deviations to that.

Join: a signature is split into chunks so that, by pigeonhole, any two within the distance agree
in some chunk up to ``errors`` symbols (one); every chunk is indexed under all ways to leave out so
many symbols, so the allowed errors are enumerated. Pairs that meet under a key are compared on whole signatures, so all pairs under the
signature distance are found. Groups under a key emit spanning forests of such pairs, never the
pairs; the components of those forests hold every candidate pair. Inside them links are confirmed
on the full sets, again as spanning forests, and their components are the result.

Large groups are split into blocks by hash, each a task's bounded work. Blocks of a group are compared
with each other only as far as the edges found inside blocks have not made their members one
component, so a family of near copies costs its size and not its square; nothing is capped or dropped.

Joins are shuffled at any size, so what the driver holds does not depend on the data.

Defined results: null texts and texts without words have empty sets and link with nothing; rows
with a null doc_id are linked with nothing and get a null component; rows sharing a doc_id are
one node, whichever texts they have.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeyline.llm.common import written
from storeyline.llm.graph import components
from storeyline.llm.textcodes import mixed

HASHES = 64
SEED = 99
#: Members of a block, and shingles of a block in the confirming step.
BLOCK = 4096
BLOCK_SHINGLES = 1_500_000
BLOCK_TEXTS = 1024

_KEY = np.uint64(0x8CB92BA72F3D8DD7)
_WORDS = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of a pseudo-random value for every byte at its place in the word.
    (A polynomial modulo 2**64 would have collisions that anyone can write down.)"""
    size = end - begin
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    at = place + np.repeat(begin, size)
    value = mixed(mixed((data[at].astype(np.uint64) + np.uint64(1)) * _KEY + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ _KEY)
    return mixed(mixed(np.add.reduceat(value, first)) ^ size.astype(np.uint64))


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted 64-bit shingle hashes of each text."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)]
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    live = ~_GAP[data]
    edge = np.diff(live.astype(np.int8))
    begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    words = np.zeros(len(begin), np.uint64)
    for at in range(0, len(begin), _WORDS):  # in pieces, for memory
        b, e = begin[at : at + _WORDS], end[at : at + _WORDS]
        words[at : at + _WORDS] = _word_hashes(data[b[0] : e[-1]], b - b[0], e - b[0])
    bounds = np.searchsorted(begin, starts)
    factor = np.random.default_rng(SEED).integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        rolled += words[j : j + n] * factor[j]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mixed(np.array([(words[a:b] * factor[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """(sets, hashes) symbols of 16 bits; zeros for empty sets."""
    rng = np.random.default_rng(SEED + 1)
    a = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    x = rng.integers(1, 1 << 63, hashes, dtype=np.uint64)
    out = np.zeros((len(sets), hashes), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        at = 0
        while at < len(full):  # in pieces that stay in cache
            upto, size = at, 0
            while upto < len(full) and (upto == at or size < 100_000):
                size += len(sets[full[upto]])
                upto += 1
            data = np.concatenate([sets[i] for i in full[at:upto]])
            starts = np.cumsum([0, *(len(sets[i]) for i in full[at : upto - 1])])
            for k in range(hashes):
                out[full[at:upto], k] = (mixed(np.minimum.reduceat((data ^ x[k]) * a[k], starts)) >> np.uint64(48)).astype(np.uint16)
            at = upto
    return out


def distance(threshold: float, hashes: int = HASHES) -> int:
    """The signature distance within which pairs at the threshold lie, but for about 1 in 30,000."""
    return min(hashes - 1, math.ceil(hashes * (1 - threshold) + 4 * math.sqrt(hashes * threshold * (1 - threshold))))


def chunk_keys(sig: np.ndarray, limit: int, errors: int = 1) -> np.ndarray:
    """(signatures, keys): 64-bit keys such that signatures within ``limit`` share one."""
    chunks = np.array_split(np.arange(sig.shape[1]), limit // (errors + 1) + 1)
    factor = np.random.default_rng(SEED + 2).integers(1, 1 << 63, sig.shape[1] + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys = []
    for number, chunk in enumerate(chunks):
        for out in combinations(range(len(chunk)), min(errors, len(chunk))):
            use = np.delete(chunk, out)
            h = np.full(len(sig), number * 4096 + sum(1 << i for i in out), np.uint64) * factor[-1]
            for c in use:
                h = mixed(h + (sig[:, c].astype(np.uint64) + np.uint64(1)) * factor[c])
            keys.append(h)
    return np.stack(keys, 1).view(np.int64)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def near_forest(sig: np.ndarray, limit: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the distance; with ``side``, of pairs between its two values."""
    n, out = len(sig), []
    waiting = np.ones(n, bool)
    for first in range(n):
        if not waiting[first]:
            continue
        waiting[first] = False
        queue = [first]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(waiting if side is None else waiting & (side != side[i]))
            if not len(rest):
                continue
            near = rest[(sig[rest] != sig[i]).sum(1) <= limit]
            waiting[near] = False
            out += [(i, int(j)) for j in near]
            queue += near.tolist()
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on the full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def link_forest(sets: list[np.ndarray], sig: np.ndarray, limit: int, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links among the pairs within the distance, nearest first."""
    n, out, forest = len(sets), [], Forest(len(sets))
    size = np.array([len(s) for s in sets])
    for level in (limit // 4, limit // 2, limit):
        for i in range(n - 1):
            rest = np.arange(i + 1, n) if side is None else np.flatnonzero(side[i + 1 :] != side[i]) + i + 1
            rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
            if len(rest):
                rest = rest[(sig[rest] != sig[i]).sum(1) <= level]
            for j in rest:
                if forest.root(i) != forest.root(j) and linked(sets[i], sets[j], percent):
                    forest.join(i, int(j))
                    out.append((i, int(j)))
    return out


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Groups of rows equal in the first columns, from rows that come sorted by them."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != last:
                if rows:
                    yield last, rows
                last, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield last, rows


def _edges(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x, y in found:
        a.append(x)
        b.append(y)
        if len(a) == 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """Groups by ``by``, each within one partition and together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)


def _own_block(group: str, member: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), F.col(group), F.col(member)), F.col("blocks")).cast("int")


def _cells(df: DataFrame, group: str, member: str) -> DataFrame:
    """Adds i <= j: a row's block with every block of its group."""
    df = df.withColumn("own", _own_block(group, member)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return df.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "own", "other")


def _apart(members: DataFrame, labels: DataFrame, group: str, member: str) -> DataFrame:
    """The members of groups of several blocks whose members are not in one component yet, with it as ``side``."""
    several = members.where("blocks > 1").join(labels.select(F.col("node").alias(member), F.col("component").alias("of")).hint("shuffle_hash"), member, "left")
    several = several.withColumn("side", F.coalesce("of", F.col(member))).drop("of")
    open_ = several.groupBy(group).agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low < high").select(group)
    return several.join(open_.hint("shuffle_hash"), group)


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, errors: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; ``docs`` needs doc_id and text."""
    limit = distance(percent / 100)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            sig = signatures(sets)
            key = [None if not len(s) else mixed(s).sum(dtype=np.uint64).tobytes() + mixed(s ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "n_shingles", "cls", "sig"])

    base = written(rows.mapInArrow(sign, "doc_id long, n_shingles long, cls binary, sig binary"))
    classes = written(base.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")))

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.array([np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()]).reshape(-1, HASHES)
            keys = chunk_keys(sig, limit, errors)
            reps = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(reps)], names=["key", "rep"])

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Forests of the pairs within the distance; of pairs of different sides where there are sides."""

        def found() -> Iterator[tuple[int, int]]:
            for _, group in _groups(batches, 3):
                if len(group) > 1:
                    sig = np.frombuffer(b"".join(r[1] for r in group), np.uint16).reshape(len(group), HASHES)
                    side = None if group[0][2] is None else np.array([r[2] for r in group])
                    for a, b in near_forest(sig, limit, side):
                        if group[a][0] != group[b][0]:
                            yield group[a][0], group[b][0]

        yield from _edges(found())

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same of confirmed links."""

        def found() -> Iterator[tuple[int, int]]:
            for _, group in _groups(batches, 3):
                if len(group) > 1:
                    sets = shingle_sets([r[1] for r in group], width)
                    side = None if group[0][2] is None else np.array([r[2] for r in group])
                    for a, b in link_forest(sets, signatures(sets), limit, percent, side):
                        yield group[a][0], group[b][0]

        yield from _edges(found())

    def families_of(members: DataFrame, group: str, payload: DataFrame, run, more: DataFrame | None = None) -> DataFrame:
        """(node, component) over all linked members of each group and the edges ``more``; ``members`` has group, rep and
        blocks, ``payload`` rep and what is compared.

        First every block by itself. Blocks of a group meet only where the edges found so, in all groups, have not made
        its members one component, and then only members of different components are compared."""
        one = members.withColumn("i", _own_block(group, "rep")).withColumn("j", F.col("i")).join(payload.hint("merge"), "rep")
        column = payload.columns[-1]
        edges = _dealt(one.select(group, "i", "j", "rep", column, F.lit(None).cast("long").alias("side")), group, "i", "j").mapInArrow(run, "a long, b long")
        labels = written(components(edges if more is None else edges.unionByName(more)))
        if members.where("blocks > 1").isEmpty():
            return labels
        apart = written(_apart(members, labels, group, "rep"))
        if apart.isEmpty():
            return labels
        cross = _dealt(_cells(apart, group, "rep").join(payload.hint("merge"), "rep").select(group, "i", "j", "rep", column, "side"), group, "i", "j").mapInArrow(run, "a long, b long")
        return written(components(cross.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))))

    keyed = classes.select("rep", "sig").mapInArrow(index, "key long, rep long")
    # a family meets under many keys: of keys with the same members one is compared
    same = [F.bit_xor(F.xxhash64(F.lit(i), "rep")).alias(f"h{i}") for i in (1, 2)]
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), *same).where("n > 1").groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key", "n")
    met = written(keyed.join(shared.hint("shuffle_hash"), "key").select("key", "rep", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    families = families_of(met, "key", classes.select("rep", "sig"), near)
    sized = families.join(classes.groupBy("rep").agg(F.max("n").alias("n")).hint("shuffle_hash"), families["node"] == F.col("rep")).select("node", "component", "n")
    weight = sized.groupBy("component").agg(F.sum("n").alias("all_n"), F.count("*").alias("members"))
    wanted = written(sized.join(weight.hint("shuffle_hash"), "component").select(F.col("node").alias("rep"), "component", F.greatest(F.ceil(F.col("all_n") / BLOCK_SHINGLES), F.ceil(F.col("members") / BLOCK_TEXTS)).alias("blocks")))
    # rows that share an id are one node: the classes of its texts are linked
    of = base.where("cls is not null and doc_id is not null").select("doc_id", "cls").join(classes.select("cls", "rep").hint("shuffle_hash"), "cls").select("doc_id", "rep").distinct()
    several = of.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b < most")
    same_id = of.join(several.hint("shuffle_hash"), "doc_id").select(F.col("rep").alias("a"), "b")
    labels = families_of(wanted, "component", rows.select(F.col("doc_id").alias("rep"), "text"), confirm, same_id)
    by_class = classes.select("cls", "rep").join(labels.withColumnRenamed("node", "rep").hint("shuffle_hash"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("of_class"))
    full = base.where("cls is not null").join(by_class.hint("shuffle_hash"), "cls", "left").select("doc_id", "n_shingles", "of_class")
    empty = base.where("cls is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("of_class"))
    by_doc = full.unionByName(empty).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id")).alias("component_id"))
    return by_doc.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
