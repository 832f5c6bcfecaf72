"""Openings, drawing content and angles: the rules between recognition and the model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeyline.functions import scalars as S
from storeyline.operators.helpers import best, cells, histogram_peak, weighted_median


def _width() -> Column:
    return F.when(F.col("orient") == "h", F.col("x1") - F.col("x0")).otherwise(F.col("y1") - F.col("y0"))


def distinct_openings(openings: DataFrame) -> DataFrame:
    """Widest first, an opening goes if a kept one covers more than 0.3 of it. A greedy fold a plan."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(w=[b - a if o == "h" else d - c for a, c, b, d, o in zip(pdf["x0"], pdf["y0"], pdf["x1"], pdf["y1"], pdf["orient"], strict=True)]).sort_values(["w", "seq"], ascending=[False, True])
        kept: list[tuple] = []
        for r in pdf.itertuples():
            area = (r.x1 - r.x0) * (r.y1 - r.y0)
            if all(max(0.0, min(r.x1, k.x1) - max(r.x0, k.x0)) * max(0.0, min(r.y1, k.y1) - max(r.y0, k.y0)) <= 0.3 * area for k in kept):
                kept.append(r)
        return pdf[pdf["seq"].isin([k.seq for k in kept])].drop(columns="w")

    return openings.groupBy("plan_id").applyInPandas(fold, openings.schema)


def plausible_openings(openings: DataFrame, plans: DataFrame) -> DataFrame:
    """Adds plausible: as wide as a wall is thick and 0.42 of the plan's median, and not much deeper than a wall."""
    by = Window.partitionBy("plan_id")
    deep = F.when(F.col("orient") == "h", F.col("y1") - F.col("y0")).otherwise(F.col("x1") - F.col("x0"))
    o = openings.join(plans.select("plan_id", "wall_px"), "plan_id").withColumn("w", _width()).withColumn("med", F.median("w").over(by))
    return o.withColumn("plausible", (F.col("w") >= F.greatest(F.col("wall_px"), 0.42 * F.col("med"))) & (deep <= 2.2 * F.col("wall_px"))).drop("w", "med", "wall_px")


def passages(openings: DataFrame) -> DataFrame:
    """Windows with rooms on both sides (``inside`` true) are doors, unless all of a plan's windows are."""
    by = Window.partitionBy("plan_id")
    window = F.col("kind") == "window"
    some = F.count_if(window & ~F.col("inside")).over(by) > 0
    return openings.withColumn("__some", some).withColumn("kind", F.when(window & F.col("inside") & F.col("__some"), "door").otherwise(F.col("kind"))).drop("__some")


def window_boxes(lines: DataFrame, gap: float) -> DataFrame:
    """(plan_id, orient, x0, y0, x1, y1, n): axis lines whose boxes touch, tightly along and up to ``gap``
    across, make one window; two lines at least. Boxes grow as they join, until nothing touches."""
    cols = ["plan_id", "orient", "x0", "y0", "x1", "y1", "n"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = bool(pdf["flat"].iloc[0])
        tx, ty = (0.2 * gap, gap) if flat else (gap, 0.2 * gap)
        groups: list[list] = []
        for r in pdf.sort_values("seq").itertuples():
            box = [min(r.x1, r.x2), min(r.y1, r.y2), max(r.x1, r.x2), max(r.y1, r.y2), 1]
            touch = [g for g in groups if g[0] - tx <= box[2] and box[0] - tx <= g[2] and g[1] - ty <= box[3] and box[1] - ty <= g[3]]
            for g in touch:
                box = [min(box[0], g[0]), min(box[1], g[1]), max(box[2], g[2]), max(box[3], g[3]), box[4] + g[4]]
                groups.remove(g)
            groups.append(box)
        plan = pdf["plan_id"].iloc[0]
        return pd.DataFrame([(plan, "h" if flat else "v", *map(float, g[:4]), g[4]) for g in groups if g[4] > 1], columns=cols)

    axis = lines.where("y1 = y2 or x1 = x2").withColumn("flat", F.col("y1") == F.col("y2"))
    return axis.groupBy("plan_id", "flat").applyInPandas(fold, "plan_id long, orient string, x0 double, y0 double, x1 double, y1 double, n long")


def in_zones(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """Lines that lie wholly in some zone."""
    size = 512.0
    z = zones.select(F.col("plan_id").alias("p"), *(F.col(c).alias(f"z_{c}") for c in ("x0", "y0", "x1", "y1")), F.explode(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)).alias("z_cell"))
    corner = F.struct(F.floor(F.least("x1", "x2") / size).alias("x"), F.floor(F.least("y1", "y2") / size).alias("y"))
    inside = (F.least("x1", "x2") >= F.col("z_x0")) & (F.greatest("x1", "x2") <= F.col("z_x1")) & (F.least("y1", "y2") >= F.col("z_y0")) & (F.greatest("y1", "y2") <= F.col("z_y1"))
    return lines.join(z, (F.col("plan_id") == F.col("p")) & (corner == F.col("z_cell")) & inside, "left_semi")


def line_choice(layer: Column, inside: Column, deep: Column, in_well: Column, essential: Column) -> Column:
    """The layer a line is drawn on, null if it is left out: stairs inside, window wells outside,
    dimensions not deep inside; everything else only in full detail, walls and openings as plain lines."""
    rest = F.when(~essential & (layer != "STAIRS"), F.when(layer.isin("WALLS", "WINDOWS", "DOORS"), "LINES").otherwise(layer))
    return F.when((layer == "STAIRS") & inside, layer).when(~layer.isin("DIMENSIONS", "TEXT") & ~inside & in_well, "WINDOWS").when((layer == "DIMENSIONS") & ~deep, layer).otherwise(rest)


def text_kept(text: Column, conf: Column, layer: Column, inside: Column, deep: Column) -> Column:
    """Whether a text is drawn in essential detail (titles go to the head of the page instead)."""
    area = text.contains("m2") | text.contains("m²")
    word = text.rlike(S.NAME_PATTERN) & (conf >= 55)
    alpha = text.rlike(r"[A-Za-zÄÖÜäöüéèàç]")
    return F.when(F.size(S.scale_ratios(text)) > 0, False).when(layer == "DIMENSIONS", ~deep).otherwise((word | area) & (alpha | (area & inside)))


def plan_titles(texts: DataFrame) -> DataFrame:
    """(plan_id, title): the first title-like text outside the building with the words of its row, left to
    right, without the scale. ``texts`` has inside."""
    out = texts.where(~F.col("inside"))
    middle, height = (F.col("y0") + F.col("y1")) / 2, F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    titles = out.where(F.col("text").rlike("(?iu)grundriss|geschoss|plan|schnitt|ansicht"))
    first = best(titles, ["plan_id"], [F.col("seq")]).select(F.col("plan_id").alias("p"), middle.alias("row_y"), height.alias("row_h"), F.col("text").alias("own"))
    row = out.where("rotation = 0 and conf >= 55").where(F.col("text").rlike(r"[A-Za-zÄÖÜäöü]")).join(first, (F.col("plan_id") == F.col("p")) & (F.abs(middle - F.col("row_y")) < 0.6 * F.col("row_h")))
    words = row.groupBy("p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "seq", "text"))), lambda s: s["text"]), " ").alias("line"))
    line = F.coalesce("line", "own")
    clean = F.btrim(F.regexp_replace(line, S.SCALE_PATTERN, ""), F.lit(" ,-–"))
    return first.join(words, "p", "left").select(F.col("p").alias("plan_id"), clean.alias("title"))


def dominant_angle(segments: DataFrame) -> DataFrame:
    """(plan_id, angle, clarity): direction of the walls in [-45, 45) from (plan_id, seq, x1, y1, x2, y2): the peak
    of the angles' histogram by length, refined by the weighted median of those within 1.5 degrees."""
    d = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    s = segments.select("plan_id", "seq", F.pmod(d + 45, F.lit(90.0)).alias("a"), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("len"))
    peak = histogram_peak(s, ["plan_id"], F.col("a"), "len").select("plan_id", ((F.col("bin") + 0.5) * 0.5).alias("peak"), "total")
    off = F.pmod(F.col("a") - F.col("peak") + 45, F.lit(90.0)) - 45
    near = s.join(peak, "plan_id").withColumn("off", off).where("abs(off) < 1.5")
    shift = weighted_median(near, ["plan_id"], "off", "len", ["seq"], "shift")
    share = near.groupBy("plan_id", "peak", "total").agg(F.sum("len").alias("hit"))
    return share.join(shift, "plan_id").select("plan_id", (F.pmod(F.col("peak") + F.col("shift"), F.lit(90.0)) - 45).alias("angle"), (F.col("hit") / F.col("total")).alias("clarity"))


def skew(segments: DataFrame, most: float = 10.0) -> DataFrame:
    """(plan_id, angle): weighted lower median of the deviations from the axes of at most ``most`` degrees."""
    d = F.pmod(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))) + 45, F.lit(90.0)) - 45
    s = segments.select("plan_id", "seq", d.alias("a"), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("len")).where(F.abs("a") <= most)
    return weighted_median(s, ["plan_id"], "a", "len", ["seq"], "angle")


def chosen_scale(tried: DataFrame, slack: float = 0.012) -> DataFrame:
    """(plan_id, scale): the largest of the scales whose confidence is about the best."""
    return tried.withColumn("top", F.max("conf").over(Window.partitionBy("plan_id"))).where(F.col("conf") >= F.col("top") - slack).groupBy("plan_id").agg(F.max("scale").alias("scale"))


def large_components(stats: DataFrame, share: float = 0.05) -> DataFrame:
    """Components of at least a share of the plan's largest."""
    return stats.withColumn("__most", F.max("area").over(Window.partitionBy("plan_id"))).where(F.col("area") >= share * F.col("__most")).drop("__most")
