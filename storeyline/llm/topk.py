"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (quarter octaves of their norm). For a query q and a bucket whose
longest vector has norm l, a product of at least t needs a cosine of at least t / (|q| l); t is a
lower bound of the query's k-th best score, taken from a bounded seed of the longest vectors. A
bucket whose local threshold exceeds 1 is skipped. Where the threshold is high, coordinate pruning
keeps the candidates whose focus coordinates lie in the range that such a cosine allows; elsewhere
length pruning keeps those long enough. What is left is verified by exact products.

Components are integers; products go through double-precision matrix products where no sum can
reach 2**53 (|q| |c| bounds it), else through Python integers.

Queries and candidates meet in blocks: each pair of a query group and a candidate block is one
task's bounded work; large buckets are split into blocks of about ``block`` rows by hash.

Queries of like need, the length that their bound asks of a candidate, form a group, so that a group
skips the buckets that none of its queries needs.

Defined results: rows with a null id, a null vector, or null or non-finite components take no
part, nor do vectors whose integer length reaches ``LONGEST``, as their scores may not fit in 64 bits; a repeated row counts once; only vectors of one dimension are compared; ties go to the
smaller id; all rows with the query's id are its own and no candidates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeyline.llm.common import written

#: Products of vectors shorter than this fit in 64 bits.
LONGEST = 2.0**31.5
SEEDS = 1024
BLOCK = 8192
QUERIES = 4096
#: From this local cosine threshold on, coordinates prune.
COORDINATE_FROM = 0.8
FOCUS = 3


def quantised(df: DataFrame, key: Column, vector: Column, factor: float = 256.0) -> DataFrame:
    """vec_id, dim, norm and vec (int64 components, floor(factor * x)) of the rows that take part."""
    source = df.select(key.cast("long").alias("vec_id"), vector.cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, norms, vecs = [], [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.values
                x = np.array([np.nan if y is None else y for y in x.to_pylist()]) if x.null_count else x.to_numpy(zero_copy_only=False)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(factor * x)
                with np.errstate(over="ignore"):
                    norm = float(np.sqrt((x * x).sum()))
                if not norm < LONGEST:
                    continue
                ids.append(i)
                dims.append(len(x))
                norms.append(norm)
                vecs.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int64()), pa.array(norms, pa.float64()), pa.array(vecs, pa.binary())], names=["vec_id", "dim", "norm", "vec"])

    return source.mapInArrow(run, "vec_id long, dim long, norm double, vec binary").dropDuplicates(["vec_id", "vec"])


def _matrix(vecs: Iterable[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(v, "<i8") for v in vecs])


def _products(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    if bound < 2.0**53:
        return np.rint(q.astype(float) @ c.astype(float).T).astype(np.int64)
    out = q.astype(object) @ c.astype(object).T
    return out.astype(np.int64)  # raises where a score needs more than 64 bits


def block_best(q_ids: np.ndarray, q: np.ndarray, q_norm: np.ndarray, least: np.ndarray, c_ids: np.ndarray, c: np.ndarray, c_norm: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score): for each query the block's k best of at least its lower bound."""
    order = np.lexsort((c_ids, -c_norm))
    c_ids, c, c_norm = c_ids[order], c[order], c_norm[order]
    longest = float(c_norm[0]) if len(c_norm) else 0.0
    out: list[tuple[int, int, int]] = []
    slack = 1 - 1e-9  # for roundings of norms

    def keep(i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ok = (scores >= least[i]) & (ids != q_ids[i])
        ids, scores = ids[ok], scores[ok]
        best = np.lexsort((ids, -scores))[:k]
        out.extend((int(q_ids[i]), int(a), int(s)) for a, s in zip(ids[best], scores[best], strict=True))

    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(least <= 0, -1.0, least * slack / (q_norm * longest))
    local = np.nan_to_num(local, nan=-1.0, posinf=2.0)
    dense = []
    unit = None
    for i in np.flatnonzero(local <= 1):
        if local[i] < COORDINATE_FROM:
            dense.append(i)
            continue
        if unit is None:
            unit = c / np.maximum(c_norm, 1e-300)[:, None]
        # a candidate needs the cosine that its own length asks for, which is the local one or more
        u = q[i] / q_norm[i]
        focus = np.argsort(-np.abs(u))[:FOCUS]
        live = np.flatnonzero(c_norm * q_norm[i] >= least[i] * slack)
        for f in focus:
            # unit vectors within the angle of u have this coordinate, taken towards u, in [low, high]
            v = abs(u[f])
            reach = np.sqrt(max(0.0, 1 - local[i] ** 2) * max(0.0, 1 - v**2)) + 1e-9
            x = unit[live, f] * (1 if u[f] >= 0 else -1)
            high = 1 + 1e-9 if v >= local[i] else v * local[i] + reach
            live = live[(x >= v * local[i] - reach) & (x <= high)]
        if len(live):
            keep(i, c_ids[live], _products(q[i : i + 1], c[live], q_norm[i] * longest)[0])
    for at in range(0, len(dense), 128):
        rows = np.array(dense[at : at + 128])
        need = np.where(least[rows] <= 0, 0, least[rows] * slack / np.maximum(q_norm[rows], 1e-300))
        upto = int(np.searchsorted(-c_norm, -need.min(), side="right"))
        if not upto:
            continue
        scores = _products(q[rows], c[:upto], float(q_norm[rows].max()) * longest)
        for i, s in zip(rows, scores, strict=True):
            if upto > 4 * k + 4:
                s = np.where(c_ids[:upto] == q_ids[i], np.iinfo(np.int64).min, s)  # the query's own rows, however many
                border = np.partition(s, upto - k)[upto - k]
                hit = np.flatnonzero(s >= border)
                keep(i, c_ids[hit], s[hit])
            else:
                keep(i, c_ids[:upto], s)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, seeds: int = SEEDS, block: int = BLOCK, group: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs as ``quantised`` returns them."""
    top = vectors.orderBy(F.desc("norm"), "vec_id").limit(seeds).toPandas()
    seed = {d: (p["vec_id"].to_numpy(), _matrix(p["vec"]), p["norm"].to_numpy()) for d, p in top.groupby("dim")}

    def bounds(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            least = np.full(len(pdf), -(2**62), np.int64)
            for d, own in pdf.reset_index(drop=True).groupby("dim"):
                if d in seed and len(seed[d][0]) > k:
                    ids, m, norms = seed[d]
                    s = _products(_matrix(own["vec"]), m, float(own["norm"].max() * norms.max()))
                    s[own["vec_id"].to_numpy()[:, None] == ids[None, :]] = -(2**62)
                    least[own.index] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            yield pd.DataFrame({"dim": pdf["dim"], "query_id": pdf["vec_id"], "q_norm": pdf["norm"], "q": pdf["vec"], "least": least})

    asked = queries.mapInPandas(bounds, "dim long, query_id long, q_norm double, q binary, least long")
    level = F.when(F.col("norm") <= 0, F.lit(-1)).otherwise(F.floor(4 * F.log2(F.col("norm") + 1))).cast("long")
    sized = vectors.withColumn("level", level)
    # lengths take few quarter octaves, whatever the number of rows
    levels = sized.groupBy("dim", "level").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    need = F.when(F.col("least") <= 0, F.lit(0.0)).otherwise(F.col("least") / F.greatest("q_norm", F.lit(1e-300)))
    asked = written(asked.withColumn("need", need).withColumn("step", F.floor(4 * F.log2(F.col("need") + 1))))
    groups = asked.groupBy("dim", "step").agg(F.ceil(F.count("*") / group).alias("groups"))  # few rows, as with levels
    cells = asked.join(F.broadcast(groups), ["dim", "step"]).withColumn("grp", F.col("step") * F.lit(1 << 32) + F.pmod(F.xxhash64("query_id"), F.col("groups"))).drop("step", "groups")
    reach = cells.groupBy("dim", "grp").agg(F.min("need").alias("need"))
    met = reach.join(F.broadcast(levels), "dim").where(F.col("longest") >= F.col("need") * (1 - 1e-9)).select("dim", "grp", "level", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
    left = cells.drop("need").join(met.select("dim", "grp", "level", "blk"), ["dim", "grp"])
    right = sized.join(F.broadcast(levels.select("dim", "level", "blocks")), ["dim", "level"]).withColumn("blk", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    right = right.join(met.select("dim", "grp", "level", "blk"), ["dim", "level", "blk"]).select("dim", "level", "blk", "grp", "vec_id", "norm", "vec")

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            found = block_best(q["query_id"].to_numpy(), _matrix(q["q"]), q["q_norm"].to_numpy(), q["least"].to_numpy(), c["vec_id"].to_numpy(), _matrix(c["vec"]), c["norm"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["dim", "grp", "level", "blk"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both came through ``met``
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
