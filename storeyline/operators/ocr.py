"""Recognised words to lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storeyline.functions.scalars import box_overlap
from storeyline.operators.helpers import islands


def usable_words(words: DataFrame, pictures: DataFrame) -> DataFrame:
    """Words read with confidence and of plausible size; ``pictures`` has plan_id, k (OCR scale),
    ocr_height and short (the plan's shorter side)."""
    w = words.withColumn("text", F.trim("text")).join(pictures, "plan_id")
    h = F.col("height") / F.col("k")
    return w.where(F.col("text").rlike(r"[\p{L}\p{N}]") & (F.col("conf") >= 60) & ((F.length("text") > 1) | (F.col("conf") >= 85)) & (h >= 7) & (h <= 0.08 * F.col("short")) & (F.col("width") / F.greatest(F.lit(1), F.col("height")) <= 25))


def text_lines(words: DataFrame, pictures: DataFrame) -> DataFrame:
    """Lines as texts: a gap of 1.6 heights begins a new one; boxes in the plan's pixels, those of
    the picture turned by 90 degrees turned back."""
    by, order = ["plan_id", "rotation", "block_num", "par_num", "line_num"], ["left", "seq"]
    win = Window.partitionBy(*by).orderBy(*order)
    w = usable_words(words, pictures)
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(win)
    w = islands(w, by, order, F.coalesce(gap >= 1.6 * F.greatest(F.col("height"), F.lag("height").over(win)), F.lit(True)))
    g = w.groupBy(*by, "island").agg(
        F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "seq", "text"))), lambda s: s["text"]), " ").alias("text"), F.avg("conf").alias("conf"), F.min("seq").alias("first"), F.first("k").alias("k"), F.first("ocr_height").alias("hh"),
    )
    turned = F.col("rotation") == 90
    box = {"x0": F.when(turned, F.col("y0")).otherwise(F.col("x0")), "x1": F.when(turned, F.col("y1")).otherwise(F.col("x1")), "y0": F.when(turned, F.col("hh") - F.col("x1")).otherwise(F.col("y0")), "y1": F.when(turned, F.col("hh") - F.col("x0")).otherwise(F.col("y1"))}
    return g.select("plan_id", (F.col("rotation") * 10_000_000 + F.col("first")).cast("long").alias("seq"), "text", *((v / F.col("k")).alias(n) for n, v in sorted(box.items())), "rotation", "conf")


def without_doubles(texts: DataFrame) -> DataFrame:
    """Of texts that overlap by a quarter of the smaller one only the better stays, best first.

    Greedy: a text is dropped by a kept one only. Overlaps come from a grid join; the fold runs over
    the overlap graph's text lists, round by round: what has no better undecided neighbour is kept,
    what meets a kept one is dropped."""
    t = texts.withColumn("score", F.col("conf") * F.length("text"))
    cell = 64.0
    cells = F.explode(F.flatten(F.transform(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)), lambda x: F.transform(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell)), lambda y: F.struct(x.alias("x"), y.alias("y"))))))
    a = t.withColumn("cell", cells)
    names = ["seq", "score", "x0", "y0", "x1", "y1"]
    b = a.select(F.col("plan_id").alias("p"), F.col("cell").alias("c"), *(F.col(n).alias(f"b_{n}") for n in names))
    shared = box_overlap([F.col(n) for n in names[2:]], [F.col(f"b_{n}") for n in names[2:]])
    area = lambda q: (F.col(f"{q}x1") - F.col(f"{q}x0")) * (F.col(f"{q}y1") - F.col(f"{q}y0"))
    better = (F.col("b_score") > F.col("score")) | ((F.col("b_score") == F.col("score")) & (F.col("b_seq") < F.col("seq")))
    edges = a.join(b, (F.col("plan_id") == F.col("p")) & (F.col("cell") == F.col("c")) & better & (shared > 0.25 * F.least(area(""), area("b_")))).groupBy("plan_id", "seq").agg(F.collect_set("b_seq").alias("over"))

    def fold(pdf):
        pdf = pdf.sort_values(["score", "seq"], ascending=[False, True])
        kept: set[int] = set()
        for seq, over in zip(pdf["seq"], pdf["over"], strict=True):
            if over is None or not kept.intersection(over):
                kept.add(seq)
        return pdf[pdf["seq"].isin(kept)][["plan_id", "seq"]]

    kept = t.select("plan_id", "seq", "score").join(edges, ["plan_id", "seq"], "left").groupBy("plan_id").applyInPandas(fold, "plan_id long, seq long")
    return texts.join(kept, ["plan_id", "seq"], "left_semi")
