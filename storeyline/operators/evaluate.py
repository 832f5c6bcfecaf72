"""Recognition against ground truth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeyline.functions.scalars import box_overlap
from storeyline.operators.helpers import cells


def matches(predicted: DataFrame, truth: DataFrame, least: float = 0.25) -> DataFrame:
    """(plan_id, kind, seq, truth_seq, iou): predictions in order take the free truth of their kind with
    the best intersection over union above ``least``. The candidate pairs are a join, the taking a fold."""
    names = ["x0", "y0", "x1", "y1"]
    t = truth.select(F.col("plan_id").alias("p"), F.col("kind").alias("k"), F.col("seq").alias("truth_seq"), *(F.col(n).alias(f"t_{n}") for n in names), F.explode(cells(*map(F.col, names), 512.0)).alias("t_cell"))
    both = box_overlap([F.col(n) for n in names], [F.col(f"t_{n}") for n in names])
    area = lambda q: (F.col(f"{q}x1") - F.col(f"{q}x0")) * (F.col(f"{q}y1") - F.col(f"{q}y0"))
    mine = predicted.withColumn("cell", F.explode(cells(*map(F.col, names), 512.0)))
    # boxes that overlap share a cell, and are taken in the first one they share
    first = (F.col("cell.x") == F.greatest(F.floor(F.col("x0") / 512.0), F.floor(F.col("t_x0") / 512.0))) & (F.col("cell.y") == F.greatest(F.floor(F.col("y0") / 512.0), F.floor(F.col("t_y0") / 512.0)))
    met = mine.join(t, (F.col("plan_id") == F.col("p")) & (F.col("kind") == F.col("k")) & (F.col("cell") == F.col("t_cell")) & first).withColumn("both", both).withColumn("iou", F.col("both") / (area("") + area("t_") - F.col("both"))).where(F.col("iou") > least)

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        out, used = [], set()
        for seq, group in pdf.sort_values(["seq", "iou", "truth_seq"], ascending=[True, False, True]).groupby("seq", sort=True):
            for r in group.itertuples():
                if r.truth_seq not in used:
                    used.add(r.truth_seq)
                    out.append((r.plan_id, r.kind, seq, r.truth_seq, r.iou))
                    break
        return pd.DataFrame(out, columns=["plan_id", "kind", "seq", "truth_seq", "iou"])

    return met.select("plan_id", "kind", "seq", "truth_seq", "iou").groupBy("plan_id", "kind").applyInPandas(take, "plan_id long, kind string, seq long, truth_seq long, iou double")


def scores(predicted: DataFrame, truth: DataFrame, matched: DataFrame) -> DataFrame:
    """(kind, tp, fp, fn, precision, recall, f1, mean_iou)."""
    a = predicted.groupBy("kind").agg(F.count("*").alias("n_pred"))
    b = truth.groupBy("kind").agg(F.count("*").alias("n_true"))
    c = matched.groupBy("kind").agg(F.count("*").alias("tp"), F.avg("iou").alias("mean_iou"))
    s = a.join(b, "kind", "full").join(c, "kind", "left").fillna(0, ["n_pred", "n_true", "tp"])
    p, r = F.col("tp") / F.greatest(F.lit(1), "n_pred"), F.col("tp") / F.greatest(F.lit(1), "n_true")
    return s.select("kind", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"), F.round("mean_iou", 6).alias("mean_iou"))


def class_iou(pixels: DataFrame) -> DataFrame:
    """(label, iou) from (truth, predicted, n) counts of pixels."""
    both = pixels.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("predicted").alias("label"), F.when(F.col("truth") == F.col("predicted"), 0).otherwise(F.col("n")).alias("n"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    return both.groupBy("label").agg((F.sum("hit") / F.sum("n")).alias("iou"))


def measured_errors(matched: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(kind, n, width_error): the mean error of the widths of matched openings, in wall thicknesses; both tables have
    width, ``truth`` wall_px."""
    p = predicted.select("plan_id", "kind", "seq", "width")
    t = truth.select("plan_id", "kind", F.col("seq").alias("truth_seq"), F.col("width").alias("t_width"), "wall_px")
    met = matched.join(p, ["plan_id", "kind", "seq"]).join(t, ["plan_id", "kind", "truth_seq"])
    return met.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("width") - F.col("t_width")) / F.col("wall_px")), 3).alias("width_error"))


def angle_errors(angles: DataFrame) -> DataFrame:
    """(n, mean, most): how far the found directions are from the true ones, modulo a quarter turn, in degrees."""
    off = F.abs(F.pmod(F.col("found") - F.col("truth") + 45, F.lit(90.0)) - 45)
    return angles.where("found is not null and truth is not null").agg(F.count("*").alias("n"), F.round(F.avg(off), 3).alias("mean"), F.round(F.max(off), 3).alias("most"))
