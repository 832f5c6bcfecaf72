"""The drawing's scale, from the most to the least reliable evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeyline.functions import scalars as S
from storeyline.operators.helpers import best, consensus, core_median


def scale_ratio(texts: DataFrame) -> DataFrame:
    """(plan_id, ratio): the common ratio of the best text; with its word first, then confidence, then order."""
    found = texts.select("plan_id", "seq", F.when(S.scale_prefixed("text"), 2).otherwise(1).alias("score"), "conf", F.posexplode(S.scale_ratios("text")).alias("i", "ratio"))
    return best(found, ["plan_id"], [F.desc("score"), F.desc("conf"), F.col("seq"), F.col("i")]).select("plan_id", "ratio")


def chain_scale(candidates: DataFrame) -> DataFrame:
    """(plan_id, mm_per_px) by consensus of the dimension chains."""
    return consensus(candidates, ["plan_id"], "mm_per_px").select("plan_id", F.col("value").alias("mm_per_px"))


def room_scale(rooms: DataFrame) -> DataFrame:
    """(plan_id, mm_per_px) from (plan_id, area_m2, area_px): two or more rooms, and 0.6 of all, within 4 % of the median."""
    r = rooms.where("area_m2 between 1 and 500 and area_px > 0").withColumn("v", F.sqrt(F.col("area_m2") * 1e6 / F.col("area_px")))
    core = core_median(r, ["plan_id"], "v", 0.04)
    return core.select("plan_id", F.when((F.col("n") >= 2) & (F.col("n_core") >= 2) & (F.col("n_core") >= 0.6 * F.col("n")), F.col("core_med")).alias("mm_per_px"))


def door_scale(openings: DataFrame, width_mm: float = 900.0) -> DataFrame:
    """(plan_id, mm_per_px) from single doors' widths (plan_id, width): three or more within 20 % of the
    median that spread by 15 % at most."""
    core = core_median(openings, ["plan_id"], "width", 0.2)
    mean = openings.join(core, "plan_id").where(F.abs(F.col("width") - F.col("med")) < 0.2 * F.col("med")).groupBy("plan_id").agg(F.avg("width").alias("mean"))
    return core.join(mean, "plan_id").select("plan_id", F.when((F.col("n") >= 3) & (F.col("n_core") >= 3) & (F.col("core_std") / F.col("mean") <= 0.15), F.lit(width_mm) / F.col("core_med")).alias("mm_per_px"))


def ladder(plans: DataFrame, chains: DataFrame, ratios: DataFrame, rooms: DataFrame, doors: DataFrame) -> DataFrame:
    """(plan_id, mm_per_px, source). ``plans`` has calibrated_mm_px, dpi, resize_factor, warped.

    Order: calibration, dimension chains, scale text with the paper's resolution, the paper itself,
    room areas, door widths. ``source`` names the step; 'paper' is a size on paper, not of a building,
    so models refuse it."""
    paper = F.when(~F.col("warped") & F.col("dpi").isNotNull(), 25.4 / (F.col("dpi") * F.col("resize_factor")))
    p = plans
    for name, df in (("chain", chains), ("rooms", rooms), ("doors", doors)):
        p = p.join(df.withColumnRenamed("mm_per_px", name), "plan_id", "left")
    p = p.join(ratios, "plan_id", "left").withColumn("paper", paper)
    steps = [("calibration", F.col("calibrated_mm_px")), ("chain", F.col("chain")), ("ratio", F.col("paper") * F.col("ratio")), ("paper", F.col("paper")), ("rooms", F.col("rooms")), ("doors", F.col("doors"))]
    return p.select("plan_id", F.coalesce(*(v for _, v in steps)).alias("mm_per_px"), F.coalesce(*(F.when(v.isNotNull(), n) for n, v in steps), F.lit("none")).alias("source"))
