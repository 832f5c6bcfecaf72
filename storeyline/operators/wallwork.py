"""Walls, gaps, openings and texts after recognition: joins, windows and rules, with small folds a plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeyline.functions import scalars as S
from storeyline.operators.helpers import band_join, best
from storeyline.operators.pixels import RECTS


def external(rects: DataFrame, ground: DataFrame, plans: DataFrame, probes: int = 15, off: float = 4.0, share: float = 0.4) -> DataFrame:
    """``rects`` with external: a long side of which over ``share`` of the probes along its middle 60 %
    stand outside the building. ``ground`` has the covered ground's run-length rows, ``plans`` the size;
    beyond the picture is not outside, as nothing is known there."""
    flat = F.col("orient") == "h"
    a, b = F.when(flat, F.col("x0")).otherwise(F.col("y0")), F.when(flat, F.col("x1")).otherwise(F.col("y1"))
    at = F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: a + (b - a) * (0.2 + 0.6 * i / (probes - 1)))
    sides = F.array(*(F.struct(F.lit(s).alias("side"), c.alias("c")) for s, c in ((0, F.when(flat, F.col("y0")).otherwise(F.col("x0")) - off), (1, F.when(flat, F.col("y1")).otherwise(F.col("x1")) + off))))
    p = rects.select("plan_id", "seq", flat.alias("flat"), at.alias("at"), F.explode(sides).alias("s")).select("plan_id", "seq", "flat", F.col("s.side").alias("side"), F.col("s.c").alias("c"), F.posexplode("at").alias("i", "a"))
    p = p.select("plan_id", "seq", "side", "i", F.bround(F.when(F.col("flat"), F.col("a")).otherwise(F.col("c"))).cast("int").alias("px"), F.bround(F.when(F.col("flat"), F.col("c")).otherwise(F.col("a"))).cast("int").alias("y"))
    p = p.join(plans.select("plan_id", "width", "height"), "plan_id").withColumn("there", F.col("px").between(0, F.col("width") - 1) & F.col("y").between(0, F.col("height") - 1))
    on = ground.select("plan_id", "y", "xa", "xb")
    covered = p.join(on, ["plan_id", "y"]).where("px between xa and xb").select("plan_id", "seq", "side", "i").withColumn("covered", F.lit(True))
    hit = p.join(covered, ["plan_id", "seq", "side", "i"], "left").groupBy("plan_id", "seq", "side").agg(F.avg((F.col("there") & F.col("covered").isNull()).cast("int")).alias("open"))
    seen = hit.groupBy("plan_id", "seq").agg((F.max("open") > share).alias("external"))
    return rects.drop("external").join(seen, ["plan_id", "seq"])


def gaps(rects: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, orient, x0, y0, x1, y1, after): the free piece between a wall and the next one along its axis,
    up to 10 wall thicknesses; the next wall overlaps 0.45 of the 2.6 halves looked at across."""
    flat = F.col("orient") == "h"
    r = rects.join(plans.select("plan_id", "wall_px"), "plan_id").select(
        "plan_id", "orient", "seq", "wall_px",
        F.when(flat, F.col("x0")).otherwise(F.col("y0")).alias("a"), F.when(flat, F.col("x1")).otherwise(F.col("y1")).alias("b"),
        F.when(flat, F.col("y0")).otherwise(F.col("x0")).alias("c"), F.when(flat, F.col("y1")).otherwise(F.col("x1")).alias("d"),
    ).where("d - c >= 0.25 * wall_px")
    every = rects.select("plan_id", F.col("seq").alias("o_seq"), F.col("x0").alias("o_x0"), F.col("y0").alias("o_y0"), F.col("x1").alias("o_x1"), F.col("y1").alias("o_y1"), F.col("orient").alias("o_orient"))
    reach = r.withColumns({"at": F.col("b") / (10 * F.col("wall_px")), "mid": (F.col("c") + F.col("d")) / 2, "half": 1.3 * (F.col("d") - F.col("c")) / 2})
    walls = []
    for o in ("h", "v"):
        lo, hi, s, e = ("o_x0", "o_x1", "o_y0", "o_y1") if o == "h" else ("o_y0", "o_y1", "o_x0", "o_x1")
        walls.append(every.join(plans.select("plan_id", "wall_px"), "plan_id").select("plan_id", F.lit(o).alias("orient"), "o_seq", F.col(lo).alias("o_a"), F.col(hi).alias("o_b"), F.col(s).alias("o_c"), F.col(e).alias("o_d"), (F.col(lo) / (10 * F.col("wall_px"))).alias("o_at")))
    across = F.least(F.col("mid") + F.col("half"), F.col("o_d")) - F.greatest(F.col("mid") - F.col("half"), F.col("o_c"))
    met = band_join(reach, walls[0].unionByName(walls[1]), ["plan_id", "orient"], "at", "o_at", 0.0, 1.0, condition=(across >= 0.45 * 2 * F.col("half")) & (F.col("o_a") - F.col("b") >= 2) & (F.col("o_seq") != F.col("seq")))
    first = best(met, ["plan_id", "seq"], [F.col("o_a"), F.col("o_seq")])
    flat = F.col("orient") == "h"
    side = lambda h, v: F.when(flat, F.col(h)).otherwise(F.col(v))
    return first.select("plan_id", "orient", side("b", "c").alias("x0"), side("c", "b").alias("y0"), side("o_a", "d").alias("x1"), side("d", "o_a").alias("y1"), F.col("seq").alias("after"))


def joined_gaps(found: DataFrame, slack: float = 3.0) -> DataFrame:
    """Parallel strips of one gap, half or more side by side and touching, become one box, until none is left:
    components of the touching relation, their boxes, again. A plan and direction is a group."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = pdf["orient"].iloc[0] == "h"
        names = ["x0", "x1", "y0", "y1"] if flat else ["y0", "y1", "x0", "x1"]
        v = pdf.sort_values(names)[names].to_numpy(float)
        while True:
            lo, hi, c, d = v.T
            along = np.minimum(hi[:, None], hi) - np.maximum(lo[:, None], lo)
            touch = (along >= 0.5 * np.minimum((hi - lo)[:, None], hi - lo)) & (np.maximum(c[:, None], c) - np.minimum(d[:, None], d) <= slack)
            label = np.arange(len(v))
            while (least := np.where(touch, label, len(v)).min(1)).tolist() != label.tolist():
                label = np.minimum(label, least)
            kinds = np.unique(label)
            if len(kinds) == len(v):
                break
            v = np.array([[lo[label == k].min(), hi[label == k].max(), c[label == k].min(), d[label == k].max()] for k in kinds])
        out = pd.DataFrame(v, columns=names).assign(plan_id=pdf["plan_id"].iloc[0], orient=pdf["orient"].iloc[0])
        return out.assign(seq=range(len(out)))[["plan_id", "seq", "x0", "y0", "x1", "y1", "orient"]]

    return found.groupBy("plan_id", "orient").applyInPandas(fold, RECTS)


def gap_kind(length: Column, t: Column, lines: Column, outer: Column, window: Column, door: Column, swing: Column) -> Column:
    """What a gap is: too short a gap is wall; lines right across it make a window if it is in the outer wall or
    there are two; a drawn swing makes a door; else what the net saw; short ones are wall; null if unclear.
    ``window`` and ``door`` are shares of the gap that the net labelled so."""
    drawn = ((lines > 0) & (outer | (lines >= 2))) | (outer & (window > 0.3))
    seen = F.when(outer & (window > door), "window").otherwise("door")
    return F.when(length < 1.5 * t, "wall").when(drawn, "window").when(swing, "door").when(window + door > 0.2, seen).when(length < 2.5 * t, "wall")


def filled_walls(stats: DataFrame) -> DataFrame:
    """Adds filled: the walls of (plan_id, wall, fill, both), areas in px, are drawn as filled areas."""
    return stats.withColumn("filled", (F.col("wall") > 0) & (F.col("fill") >= 0.4 * F.greatest("wall", F.lit(1))) & (F.col("both") >= 0.7 * F.col("wall")) & (F.col("both") >= 0.6 * F.col("fill")))


def opening_orients(found: DataFrame) -> DataFrame:
    """Adds orient: the direction in which more wall stands beside an opening; without enough wall only openings of
    two thicknesses stay. Shares of wall: left, right, above, below."""
    along, across = F.col("left") + F.col("right"), F.col("above") + F.col("below")
    long_enough = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= 2 * F.col("wall_px")
    return found.withColumn("orient", F.when(along >= across, "h").otherwise("v")).where((F.greatest(along, across) >= 0.15) | long_enough)


def swings(candidates: DataFrame) -> DataFrame:
    """(plan_id, seq, side, hinge, score): the best of an opening's candidates (side -1, 1; hinge 'start', 'end',
    'both') by 0.7 arc + 0.3 leaf where the arc is drawn; a double door needs a clearer case; 0.42 at least."""
    one = F.when(F.col("arc") >= 0.5, 0.7 * F.col("arc") + 0.3 * F.col("leaf")).otherwise(0.0) - F.when(F.col("hinge") == "both", 0.03).otherwise(0.0)
    order = F.when(F.col("hinge") == "start", 0).when(F.col("hinge") == "end", 1).otherwise(2)
    ranked = best(candidates.withColumn("score", one), ["plan_id", "seq"], [F.desc(F.round("score", 9)), F.col("side"), order])
    return ranked.where("score >= 0.42").select("plan_id", "seq", "side", "hinge", "score")


def edges(profiles: DataFrame) -> DataFrame:
    """(plan_id, seq, at): where ink turns to paper near an edge: the step d with the largest inside - outside -
    0.02 |d|, if that exceeds 0.25, else the edge itself. Rows: plan_id, seq, at, d, inner, outer."""
    score = F.col("inner") - F.col("outer") - 0.02 * F.abs("d")
    ranked = best(profiles.withColumn("s", score), ["plan_id", "seq"], [F.desc(F.round("s", 9)), F.col("d")])
    return ranked.select("plan_id", "seq", F.when(F.col("s") > 0.25, F.col("at") + F.col("d")).otherwise(F.col("at")).alias("at"))


def dashes(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end): runs of set samples (i, v), the end exclusive."""
    i = F.col("i") - F.row_number().over(Window.partitionBy(*by).orderBy("i"))
    return samples.where("v").withColumn("run", i).groupBy(*by, "run").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end")).drop("run")


def nearest_dash(found: DataFrame, by: list[str], zero: int, reach: float) -> DataFrame:
    """The run that holds ``zero`` or comes nearest to it, within reach; of equals the first."""
    off = F.when((F.col("start") <= zero) & (F.col("end") > zero), 0).otherwise(F.least(F.abs(F.col("start") - zero), F.abs(F.col("end") - 1 - zero)))
    return best(found.withColumn("off", off).where(F.col("off") <= reach), by, [F.col("off"), F.col("start")]).drop("off")


def partners(lines: DataFrame, least: float, most: float) -> DataFrame:
    """(plan_id, seq, partner, lo, hi, f0, f1): each wall line's nearest parallel within [least, most] that shares
    0.3 of the shorter, and the box between the two; ties go to the first."""
    g = lines.where("x1 = x2 or y1 = y2").withColumn("flat", F.col("y1") == F.col("y2"))
    side = lambda a, b: F.when(F.col("flat"), F.col(a)).otherwise(F.col(b))
    g = g.select("plan_id", "flat", "seq", side("y1", "x1").alias("at"), F.least(side("x1", "y1"), side("x2", "y2")).alias("a0"), F.greatest(side("x1", "y1"), side("x2", "y2")).alias("a1"))
    other = g.select("plan_id", "flat", F.col("seq").alias("partner"), F.col("at").alias("o_at"), F.col("a0").alias("o_a0"), F.col("a1").alias("o_a1"))
    shared = S.overlap(F.col("a0"), F.col("a1"), F.col("o_a0"), F.col("o_a1")) >= 0.3 * F.least(F.col("a1") - F.col("a0"), F.col("o_a1") - F.col("o_a0"))
    away = F.abs(F.col("o_at") - F.col("at"))
    met = band_join(g, other, ["plan_id", "flat"], "at", "o_at", -most, most, condition=(away >= least) & shared & (F.col("seq") != F.col("partner"))).withColumn("away", away)
    near = best(met, ["plan_id", "seq"], [F.col("away"), F.col("partner")])
    return near.select("plan_id", "seq", "partner", F.greatest("a0", "o_a0").alias("lo"), F.least("a1", "o_a1").alias("hi"), F.least("at", "o_at").alias("f0"), F.greatest("at", "o_at").alias("f1"))


def squared(rects: DataFrame, t: float) -> DataFrame:
    """Wall ends at crossing walls: a T ends in the middle of the wall it meets, an L at the outer face, to which the
    other wall is drawn as well. Pairs in order, each seeing what earlier ones moved: a fold a plan."""
    tol = max(2.0, 0.6 * t)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        box, steep = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float).copy(), (pdf["orient"] == "v").to_numpy().astype(int)
        for i in range(len(box)):
            along, across = ([0, 2], [1, 3]) if not steep[i] else ([1, 3], [0, 2])
            for j in np.flatnonzero(steep != steep[i]):
                middle = box[i, across].mean()
                if not box[j, across[0]] - tol <= middle <= box[j, across[1]] + tol:
                    continue
                face, reach, own = box[j, along].copy(), box[j, across].copy(), box[i, across].copy()
                for outer, end in enumerate(along):
                    if not face[0] - tol <= box[i, end] <= face[1] + tol:
                        continue
                    if reach[0] < own[0] - tol and reach[1] > own[1] + tol:
                        box[i, end] = face.mean()
                    else:
                        box[i, end] = face[outer]
                        if reach[1] > own[1]:
                            box[j, across[0]] = min(box[j, across[0]], own[0])
                        if reach[0] < own[0]:
                            box[j, across[1]] = max(box[j, across[1]], own[1])
        pdf[["x0", "y0", "x1", "y1"]] = box
        return pdf[["plan_id", "seq", "x0", "y0", "x1", "y1", "orient"]]

    return rects.groupBy("plan_id").applyInPandas(fold, RECTS)


def straightened(ring: Column, degrees: float = 6.0) -> Column:
    """A closed ring [(x, y)] whose edges near an axis lie on it exactly, without points on straight lines.

    An edge near the horizontal takes the mean height of its ends, one near the vertical their mean x."""
    n = F.size(ring)
    at = lambda r, i: F.element_at(r, (F.pmod(i, F.size(r)) + 1).cast("int"))
    near = lambda p, q: F.pmod(F.degrees(F.atan2(q["y"] - p["y"], q["x"] - p["x"])), F.lit(180.0))
    kind = lambda p, q: F.when((near(p, q) < degrees) | (near(p, q) > 180 - degrees), "h").when(F.abs(near(p, q) - 90) < degrees, "v").otherwise("d")

    def moved(p: Column, i: Column) -> Column:
        before, after = at(ring, i - 1), at(ring, i + 1)
        x = F.when(kind(p, after) == "v", (p["x"] + after["x"]) / 2).when(kind(before, p) == "v", (before["x"] + p["x"]) / 2).otherwise(p["x"])
        y = F.when(kind(p, after) == "h", (p["y"] + after["y"]) / 2).when(kind(before, p) == "h", (before["y"] + p["y"]) / 2).otherwise(p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    out = F.transform(ring, moved)
    bends = lambda p, i: F.abs((p["x"] - at(out, i - 1)["x"]) * (at(out, i + 1)["y"] - p["y"]) - (p["y"] - at(out, i - 1)["y"]) * (at(out, i + 1)["x"] - p["x"])) > 1e-6
    return F.when(n < 3, ring).when(n == 3, out).otherwise(F.filter(out, bends))


def text_heights(texts: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, text_h): the median height of a plan's texts, else 0.012 of the shorter side."""
    h = texts.where("rotation = 0").groupBy("plan_id").agg(F.median(F.col("y1") - F.col("y0")).alias("h"))
    return plans.select("plan_id", "short").join(h, "plan_id", "left").select("plan_id", F.coalesce("h", 0.012 * F.col("short")).alias("text_h"))


def alike_heights(texts: DataFrame, ratio: float = 1.2) -> DataFrame:
    """(plan_id, seq, cap): the median of the heights within ``ratio`` of a text's own. Heights meet by
    buckets of their logarithm."""
    t = texts.where("height > 0").select("plan_id", "seq", F.log("height").alias("at"), "height")
    other = t.select("plan_id", F.col("at").alias("o_at"), F.col("height").alias("o_h"))
    near = (F.col("o_h") > F.col("height") / ratio) & (F.col("o_h") < F.col("height") * ratio)
    width = float(np.log(ratio))
    met = band_join(t, other, ["plan_id"], "at", "o_at", -width, width, condition=near)
    return met.groupBy("plan_id", "seq").agg(F.median("o_h").alias("cap"))


def readable(texts: DataFrame, components: DataFrame) -> DataFrame:
    """Texts whose box looks like writing: some ink and not full, about a component of ink a character, and no
    frame around. ``texts`` has ink, the share of set pixels; ``components`` left, top, right, bottom, area.

    Components and padded boxes meet by cells of 128 px of the component's corner."""
    h = F.when(F.col("rotation") == 0, F.col("y1") - F.col("y0")).otherwise(F.col("x1") - F.col("x0"))
    letters, chars = F.length(F.regexp_replace("text", r"[^\p{L}]", "")), F.length(F.replace("text", F.lit(" "), F.lit("")))
    number = F.trim("text").rlike(r"^\d{1,3}[.,]\d{1,2}$")
    sure = ((F.col("conf") >= 85) & ((letters >= 3) | number)) | ((F.col("conf") >= 75) & (letters >= 5))
    t = texts.withColumns({"pad": F.greatest(F.lit(2.0), 0.25 * h), "sure": sure, "chars": chars, "word": (F.col("conf") >= 75) & (letters >= 4)})
    t = t.where((F.col("ink") >= 0.04) & (F.col("ink") <= F.when(F.col("sure"), 0.75).otherwise(0.55)))
    cell = 128.0
    span = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    cells = F.explode(F.flatten(F.transform(span(F.col("x0") - F.col("pad"), F.col("x1") + F.col("pad")), lambda x: F.transform(span(F.col("y0") - F.col("pad"), F.col("y1") + F.col("pad")), lambda y: F.struct(x.alias("x"), y.alias("y"))))))
    c = components.where("area >= 3").select("plan_id", "left", "top", "right", "bottom", F.struct(F.floor(F.col("left") / cell).alias("x"), F.floor(F.col("top") / cell).alias("y")).alias("cell"))
    inside = (F.col("left") >= F.col("x0") - F.col("pad")) & (F.col("top") >= F.col("y0") - F.col("pad")) & (F.col("right") <= F.col("x1") + F.col("pad")) & (F.col("bottom") <= F.col("y1") + F.col("pad"))
    frame = (F.col("right") - F.col("left") > 0.7 * (F.col("x1") - F.col("x0"))) & (F.col("bottom") - F.col("top") > 0.7 * (F.col("y1") - F.col("y0")))
    met = t.withColumn("cell", cells).join(c, ["plan_id", "cell"]).where(inside).groupBy("plan_id", "seq").agg(F.count("*").alias("parts"), F.max(frame).alias("framed"))
    need = F.greatest(F.lit(1), F.ceil(F.when(F.col("word"), 0.25).otherwise(0.6) * F.col("chars")))
    framed = F.col("framed") & (F.col("chars") > 1) & ~(F.col("sure") & (F.col("conf") >= 90))
    return t.join(met, ["plan_id", "seq"]).where((F.col("parts") >= need) & ~framed).select(texts.columns)


def room_of_every_text(texts: DataFrame, rooms: DataFrame, ground: DataFrame) -> DataFrame:
    """(plan_id, seq, label): the room of a text; texts on covered ground outside all rooms get a place of their
    own, -1, -2, ... in their order, so that stamps in open areas are found as well."""
    cx, cy = F.floor((F.col("x0") + F.col("x1")) / 2), F.floor((F.col("y0") + F.col("y1")) / 2)
    t = texts.select("plan_id", "seq", cx.alias("cx"), cy.cast("int").alias("y"))
    hit = lambda runs: t.join(runs.select("plan_id", "label", "y", "xa", "xb"), ["plan_id", "y"]).where("cx between xa and xb").select("plan_id", "seq", "label")
    inside = hit(rooms)
    loose = hit(ground).join(inside, ["plan_id", "seq"], "left_anti")
    own = -F.row_number().over(Window.partitionBy("plan_id").orderBy("seq"))
    return inside.unionByName(loose.select("plan_id", "seq", own.cast("long").alias("label")))


def door_boxes(arcs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(plan_id, seq, x0, y0, x1, y1, orient): the opening of a door's arc. ``evidence`` has for either leg of the
    arc (leg, dx, dy, c0, c1, wall, free, length): its direction, the wall's run across, the shares of wall behind
    the hinge and of free ground ahead, and the measured length. Legs along an axis with 0.6 of both
    count; the best sum wins, then the first leg."""
    straight = F.greatest(F.abs("dx"), F.abs("dy")) > 0.97
    e = evidence.where(straight & (F.col("wall") >= 0.6) & (F.col("free") >= 0.6))
    e = best(e.withColumn("score", F.round(F.col("wall") + F.col("free"), 9)), ["plan_id", "seq"], [F.desc("score"), F.col("leg")])
    flat = F.abs("dx") > 0.97
    ux, uy = F.when(flat, F.signum("dx")).otherwise(0.0), F.when(flat, 0.0).otherwise(F.signum("dy"))
    e = e.join(arcs.select("plan_id", "seq", "cx", "cy"), ["plan_id", "seq"])
    xs, ys = ([F.col(c) + u * a + n * b for a in (F.lit(0.0), F.col("length")) for b in (F.col("c0"), F.col("c1"))] for c, u, n in (("cx", ux, -uy), ("cy", uy, ux)))
    return e.select("plan_id", "seq", F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"), F.when(flat, "h").otherwise("v").alias("orient"))


def picture_checks(stats: DataFrame, most: int = 4500, least: int = 1800) -> DataFrame:
    """(plan_id, factor, inverted, warnings, error): how a picture is prepared. ``stats`` has width, height, median,
    light, blur and ink (share of set pixels); null where not measured."""
    side = F.greatest("width", "height")
    factor = F.when(side > most, most / side).when(side < least, least / side).otherwise(1.0)
    poor = (side < least) | F.coalesce(F.col("blur") < 40, F.lit(False)) | F.coalesce(F.col("ink") > 0.30, F.lit(False))
    inverted = (F.col("median") < 110) & (F.col("light") > 150)
    warnings = F.array_compact(F.array(F.when(poor, "low quality"), F.when(inverted, "light lines on dark ground")))
    error = F.when(F.least("width", "height") < 300, "the picture is too small").when(F.col("ink") < 0.0005, "no lines were found")
    return stats.select("plan_id", factor.alias("factor"), inverted.alias("inverted"), warnings.alias("warnings"), error.alias("error"))


def ocr_scale(width: Column, height: Column, most: float = 3200.0) -> Column:
    """The factor by which a picture goes to text recognition; about 1 is 1."""
    k = F.least(F.lit(2.0), most / F.greatest(width, height))
    return F.when(F.abs(k - 1) < 0.05, 1.0).otherwise(k)


def stamp_frames(sides: DataFrame) -> DataFrame:
    """(plan_id, seq): stamps with ink along 0.85 of all four sides of a frame; rows (plan_id, seq, side, ink)."""
    return sides.groupBy("plan_id", "seq").agg(F.count_if(F.col("ink") >= 0.85).alias("n")).where("n = 4").select("plan_id", "seq")


def warnings_of(parts: Column) -> Column:
    """Warnings without repeats, in the order of their first mention."""
    return F.array_distinct(F.array_compact(parts))


