"""Lists of rendering jobs for a training set, and their runs: one row a job, errors kept as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The step through a split's plans and the first seed of each split.
STEP = 7919
FIRST_SEED = {"train": 0, "val": 5_000_000, "test": 6_000_000}


def jobs(spark: SparkSession, counts: dict[str, int], plans: DataFrame, offset: int = 0) -> DataFrame:
    """(split, idx, seed): job k of a split renders its plan (k * STEP) % n. ``plans`` has split, pos and idx."""
    out = None
    sizes = plans.groupBy("split").agg(F.count("*").alias("n"))
    for split, count in counts.items():
        part = spark.range(count).select(F.lit(split).alias("split"), F.col("id").alias("k"), (F.col("id") + FIRST_SEED[split] + offset).alias("seed"))
        out = part if out is None else out.unionByName(part)
    placed = out.join(sizes, "split").withColumn("pos", F.pmod(F.col("k") * STEP, F.col("n")))
    return placed.join(plans, ["split", "pos"]).select("split", "idx", "seed")


def run_jobs(listed: DataFrame, made: Callable[[int, int], dict | None]) -> DataFrame:
    """(split, idx, seed, name, wall_px, error): what ``made(idx, seed)`` returns; None leaves no row, an
    exception a row that says so."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    got = made(int(r.idx), int(r.seed))
                except Exception as e:  # noqa: BLE001
                    rows.append((r.split, r.idx, r.seed, None, None, repr(e)))
                    continue
                if got is not None:
                    rows.append((r.split, r.idx, r.seed, f"{r.seed:07d}", got.get("wall_px"), None))
            yield pd.DataFrame(rows, columns=["split", "idx", "seed", "name", "wall_px", "error"])

    return listed.mapInPandas(run, "split string, idx long, seed long, name string, wall_px double, error string")
