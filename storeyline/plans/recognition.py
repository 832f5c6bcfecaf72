"""``geo_*`` queries of the recognition rules: literal rows, and oracle SQL that computes from the same rows
wherever the rule has a set form; folds and pixel kernels have their few result rows listed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeyline.functions import scalars as S
from storeyline.operators import bim, evaluate, perspective, pixels, wallwork
from storeyline.operators.raster import MASKS
from storeyline.plans.fixtures import _model, _rows, _sql
from storeyline.sinks import results
from storeyline.sources import jobs
from storeyline.sources.schemas import RECTS

# -- pixels: a house of 60 x 40 px with walls of 4 px, a gap of 8 px in the lower wall and one inner wall

_H, _W = 56, 76


def _house() -> np.ndarray:
    m = np.zeros((_H, _W), np.uint8)
    m[8:48, 8:68] = 1
    m[12:44, 12:64] = 0
    m[12:44, 36:40] = 1
    m[44:48, 20:28] = 0
    return m


def _masks(spark: SparkSession, m: np.ndarray, **more: object) -> DataFrame:
    df = _rows(spark, [(1, m.shape[1], m.shape[0], bytearray(m.tobytes()))], MASKS)
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def geo_binarized(spark: SparkSession, _: str) -> DataFrame:
    """Dark strokes and a faint one on uneven paper; a lone speck goes."""
    g = np.tile(np.linspace(200, 245, 90).astype(np.uint8), (80, 1))
    g[20:24, 10:80], g[50, 10:80], g[70, 5] = 30, 185, 20
    found = pixels.binarized(_masks(spark, g))
    return found.select("plan_id", F.length(F.regexp_replace(F.hex("data"), "00", "")).cast("long").alias("digits"))


def geo_footprint(spark: SparkSession, _: str) -> DataFrame:
    return pixels.footprints(_masks(spark, _house()), 13).groupBy("plan_id").agg(F.sum(F.col("xb") - F.col("xa") + 1).alias("area"), F.min("y").cast("long").alias("top"), F.max("xb").cast("long").alias("right"))


def geo_rooms(spark: SparkSession, _: str) -> DataFrame:
    m = _house()
    m[44:48, 20:28] = 1  # the opening counts as closed
    found = pixels.rooms(_masks(spark, m, wall_px=4.0), 5)
    return found.groupBy("plan_id", "label").agg(F.sum(F.col("xb") - F.col("xa") + 1).alias("area"), F.min("xa").cast("long").alias("left"))


def geo_thickness(spark: SparkSession, _: str) -> DataFrame:
    return pixels.thicknesses(_masks(spark, _house()))


def geo_boxes(spark: SparkSession, _: str) -> DataFrame:
    return pixels.boxes(_masks(spark, _house()), 10.0).select("orient", "x0", "y0", "x1", "y1")


def geo_vectors(spark: SparkSession, _: str) -> DataFrame:
    m = np.zeros((60, 120), np.uint8)
    m[30:32, 10:110] = 1
    m[10:30, 60:62] = 1
    found = pixels.vectors(_masks(spark, m)).where("kind = 'line'")
    x1, y1, x2, y2 = (F.col("v")[i] for i in range(4))
    size = F.hypot(x2 - x1, y2 - y1)
    return found.where(size > 10).select(F.when(F.abs(y2 - y1) < F.abs(x2 - x1), "h").otherwise("v").alias("orient"), (F.round(size / 10) * 10).alias("tens"), (F.col("v")[4] >= 1.5).alias("wide"))


def geo_arc(spark: SparkSession, _: str) -> DataFrame:
    a = np.radians(np.arange(0, 91, 2.0))
    rows = [("quarter", *pixels.arc_of(np.stack([50 + 30 * np.cos(a), 40 + 30 * np.sin(a)], 1), 2.0, 100.0))]
    b = np.radians(np.arange(0, 360, 4.0))
    rows.append(("circle", *pixels.arc_of(np.stack([50 + 30 * np.cos(b), 40 + 30 * np.sin(b)], 1), 2.0, 100.0)))
    straight = pixels.arc_of(np.stack([np.arange(40.0), np.arange(40.0) * 0.001], 1), 2.0, 100.0)
    rows.append(("line", *(straight or [0.0] * 5)))
    df = _rows(spark, [(k, *map(float, v)) for k, *v in rows], "what string, cx double, cy double, r double, start double, stop double")
    return df.select("what", *(F.round(c, 3).alias(c) for c in ("cx", "cy", "r", "start", "stop")))


def geo_stroke(spark: SparkSession, _: str) -> DataFrame:
    m = np.zeros((60, 200), np.uint8)
    for y in (10, 30, 50):
        m[y : y + 3, 5:195] = 1
    wall = bytearray(np.ones_like(m).tobytes())
    return pixels.stroke_widths(_masks(spark, m, wall_px=10.0).withColumn("wall", F.lit(wall)))


# -- walls

_RECTS = [(1, 8.0, 8.0, 68.0, 12.0, "h"), (2, 8.0, 44.0, 20.0, 48.0, "h"), (3, 28.0, 44.0, 68.0, 48.0, "h"), (4, 36.0, 12.0, 40.0, 44.0, "v")]
_RECT_COLUMNS = "seq, x0, y0, x1, y1, orient"


def _rects(spark: SparkSession) -> DataFrame:
    return _rows(spark, [(1, *r) for r in _RECTS], RECTS)


def geo_external(spark: SparkSession, _: str) -> DataFrame:
    ground = pixels.footprints(_masks(spark, _house()), 13)
    plans = _rows(spark, [(1, _W, _H)], "plan_id long, width int, height int")
    return wallwork.external(_rects(spark), ground, plans).select("seq", "external")


def geo_gaps(spark: SparkSession, _: str) -> DataFrame:
    return wallwork.gaps(_rects(spark), _rows(spark, [(1, 4.0)], "plan_id long, wall_px double")).select("orient", "x0", "y0", "x1", "y1", "after")


def geo_joined_gaps(spark: SparkSession, _: str) -> DataFrame:
    rows = [("h", 0.0, 0.0, 10.0, 4.0), ("h", 1.0, 6.0, 11.0, 10.0), ("h", 2.0, 12.0, 9.0, 14.0), ("h", 30.0, 0.0, 40.0, 4.0), ("v", 0.0, 0.0, 10.0, 4.0)]
    return wallwork.joined_gaps(_rows(spark, [(1, *r) for r in rows], "plan_id long, orient string, x0 double, y0 double, x1 double, y1 double")).select("orient", "seq", "x0", "y0", "x1", "y1")


_GAPS = [(1, 5.0, 4.0, 0, False, 0.0, 0.0, False), (2, 20.0, 4.0, 1, True, 0.0, 0.0, False), (3, 20.0, 4.0, 1, False, 0.0, 0.0, True), (4, 20.0, 4.0, 2, False, 0.0, 0.0, False), (5, 20.0, 4.0, 0, True, 0.4, 0.0, False), (6, 20.0, 4.0, 0, True, 0.15, 0.1, False), (7, 20.0, 4.0, 0, False, 0.2, 0.1, False), (8, 9.0, 4.0, 0, False, 0.0, 0.0, False), (9, 20.0, 4.0, 0, True, 0.0, 0.0, False)]
_GAP_COLUMNS = "seq, length, t, lines, outside, window_share, door_share, swing"


def geo_gap_kind(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, _GAPS, "seq long, length double, t double, lines int, outside boolean, window_share double, door_share double, swing boolean")
    return d.select("seq", wallwork.gap_kind(*(F.col(c) for c in ("length", "t", "lines", "outside", "window_share", "door_share", "swing"))).alias("kind"))


_FILLS = [(1, 100, 90, 80), (2, 100, 30, 30), (3, 0, 50, 0), (4, 100, 200, 90), (5, 100, 100, 69), (6, 100, 120, 75)]


def geo_filled_walls(spark: SparkSession, _: str) -> DataFrame:
    return wallwork.filled_walls(_rows(spark, _FILLS, "plan_id long, wall long, fill long, both long")).select("plan_id", "filled")


_FOUND = [(1, 0.0, 0.0, 20.0, 4.0, 0.9, 0.8, 0.1, 0.0), (2, 0.0, 0.0, 4.0, 20.0, 0.1, 0.0, 0.9, 0.7), (3, 0.0, 0.0, 5.0, 5.0, 0.05, 0.05, 0.0, 0.0), (4, 0.0, 0.0, 9.0, 5.0, 0.0, 0.0, 0.0, 0.0)]
_FOUND_COLUMNS = "seq, x0, y0, x1, y1, left_wall, right_wall, above, below"


def geo_opening_orients(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, [(1, *r, 4.0) for r in _FOUND], "plan_id long, seq long, x0 double, y0 double, x1 double, y1 double, left double, right double, above double, below double, wall_px double")
    return wallwork.opening_orients(d).select("seq", "orient")


_SWINGS = [(1, -1, "start", 0.9, 0.5), (1, -1, "end", 0.4, 0.9), (1, 1, "both", 0.92, 0.52), (2, -1, "start", 0.6, 0.0), (2, 1, "both", 0.6, 0.1), (3, 1, "end", 0.45, 1.0), (4, 1, "start", 0.7, 0.2), (4, 1, "end", 0.7, 0.2)]


def geo_swings(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, [(1, *r) for r in _SWINGS], "plan_id long, seq long, side int, hinge string, arc double, leaf double")
    return wallwork.swings(d).select("seq", "side", "hinge", F.round("score", 4).alias("score"))


_PROFILES = [(1, 10.0, d, i, o) for d, i, o in ((-2, 0.1, 0.0), (-1, 0.9, 0.1), (0, 0.6, 0.5), (1, 0.9, 0.1))] + [(2, 30.0, d, 0.2, 0.1) for d in (-1, 0, 1)]


def geo_edges(spark: SparkSession, _: str) -> DataFrame:
    return wallwork.edges(_rows(spark, [(1, *r) for r in _PROFILES], "plan_id long, seq long, at double, d int, inner double, outer double")).select("seq", "at")


_SAMPLES = [(k, i, c == "#") for k, row in ((1, "..###.#..##"), (2, "#########"), (3, ".....")) for i, c in enumerate(row)]


def geo_dashes(spark: SparkSession, _: str) -> DataFrame:
    return wallwork.dashes(_rows(spark, _SAMPLES, "line long, i int, v boolean"), ["line"])


def geo_nearest_dash(spark: SparkSession, _: str) -> DataFrame:
    return wallwork.nearest_dash(geo_dashes(spark, _), ["line"], 7, 2.0)


_WALL_LINES = [(1, 0.0, 0.0, 100.0, 0.0), (2, 10.0, 20.0, 90.0, 20.0), (3, 0.0, 30.0, 100.0, 30.0), (4, 95.0, 10.0, 200.0, 10.0), (5, 50.0, 0.0, 50.0, 80.0), (6, 62.0, 0.0, 62.0, 90.0)]


def geo_partners(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, [(1, *r) for r in _WALL_LINES], "plan_id long, seq long, x1 double, y1 double, x2 double, y2 double")
    return wallwork.partners(d, 5.0, 25.0).select("seq", "partner", "lo", "hi", "f0", "f1")


def geo_squared(spark: SparkSession, _: str) -> DataFrame:
    rows = [(1, 0.0, 0.0, 98.0, 10.0, "h"), (2, 101.0, 2.0, 111.0, 80.0, "v"), (3, 3.0, 40.0, 99.0, 46.0, "h"), (4, 300.0, 0.0, 310.0, 80.0, "v")]
    return wallwork.squared(_rows(spark, [(1, *r) for r in rows], RECTS), 10.0).select("seq", "x0", "y0", "x1", "y1")


def geo_straightened(spark: SparkSession, _: str) -> DataFrame:
    rings = [(1, [(0.0, 0.0), (50.0, 1.0), (100.0, 0.0), (101.0, 60.0), (0.0, 60.0)]), (2, [(0.0, 0.0), (10.0, 10.0)])]
    d = _rows(spark, rings, "i long, ring array<struct<x:double,y:double>>")
    said = F.transform(wallwork.straightened(F.col("ring")), lambda p: F.concat_ws(" ", F.round(p["x"], 2).cast("string"), F.round(p["y"], 2).cast("string")))
    return d.select("i", F.array_join(said, ",").alias("ring"))


# -- texts

_HEIGHTS = [(1, 10.0), (2, 11.0), (3, 12.5), (4, 30.0), (5, 29.0), (6, 100.0)]


def geo_alike_heights(spark: SparkSession, _: str) -> DataFrame:
    return wallwork.alike_heights(_rows(spark, [(1, *r) for r in _HEIGHTS], "plan_id long, seq long, height double")).select("seq", "cap")


def geo_text_heights(spark: SparkSession, _: str) -> DataFrame:
    texts = _rows(spark, [(1, 0, 0.0, 12.0), (1, 0, 5.0, 19.0), (1, 90, 0.0, 90.0), (1, 0, 0.0, 20.0)], "plan_id long, rotation int, y0 double, y1 double")
    return wallwork.text_heights(texts, _rows(spark, [(1, 1000.0), (2, 1500.0)], "plan_id long, short double"))


def geo_readable(spark: SparkSession, _: str) -> DataFrame:
    t = [(1, "Bad", 90.0, 0.0, 40.0, 0.2), (2, "Bad", 90.0, 100.0, 140.0, 0.8), (3, "Zimmer", 50.0, 200.0, 260.0, 0.3), (4, "x", 60.0, 300.0, 310.0, 0.02), (5, "Wohnen", 80.0, 400.0, 470.0, 0.3), (6, "WC", 60.0, 600.0, 640.0, 0.3)]
    texts = _rows(spark, [(1, i, s, c, 0, a, 10.0, b, 30.0, k) for i, s, c, a, b, k in t], "plan_id long, seq long, text string, conf double, rotation int, x0 double, y0 double, x1 double, y1 double, ink double")
    letters = [(12.0 * k, 12.0 * k + 9) for k in range(3)] + [(200.0, 209.0)] + [(400.0 + 12 * k, 409.0 + 12 * k) for k in range(2)] + [(600.0, 640.0), (602.0, 611.0)]
    parts = _rows(spark, [(1, int(a), 11, int(b), 28, 60) for a, b in letters] + [(1, 30, 12, 32, 14, 2)], "plan_id long, left int, top int, right int, bottom int, area long")
    return wallwork.readable(texts, parts).select("seq", "text")


_RUNS = [(1, y, 0, 49) for y in range(0, 40)]
_GROUND = [(1, y, 0, 99) for y in range(0, 40)]
_CENTRES = [(1, 10.0, 10.0), (2, 70.0, 10.0), (3, 80.0, 30.0), (4, 200.0, 10.0)]


def geo_open_rooms(spark: SparkSession, _: str) -> DataFrame:
    texts = _rows(spark, [(1, s, x - 5, y - 5, x + 5, y + 5) for s, x, y in _CENTRES], "plan_id long, seq long, x0 double, y0 double, x1 double, y1 double")
    run = "plan_id long, label long, y int, xa int, xb int"
    return wallwork.room_of_every_text(texts, _rows(spark, [(1, *r) for r in _RUNS], run), _rows(spark, [(1, *r) for r in _GROUND], run)).select("seq", "label")


def geo_door_boxes(spark: SparkSession, _: str) -> DataFrame:
    arcs = _rows(spark, [(1, 1, 100.0, 50.0), (1, 2, 10.0, 10.0)], "plan_id long, seq long, cx double, cy double")
    legs = [(1, 1, 1.0, 0.0, -3.0, 3.0, 0.9, 0.8, 40.0), (1, 2, 0.0, 1.0, -3.0, 3.0, 0.9, 0.9, 42.0), (2, 1, 0.7, 0.7, -3.0, 3.0, 1.0, 1.0, 40.0), (2, 2, -0.99, 0.1, -2.0, 4.0, 0.7, 0.7, 30.0)]
    evidence = _rows(spark, [(1, *r) for r in legs], "plan_id long, seq long, leg int, dx double, dy double, c0 double, c1 double, wall double, free double, length double")
    return wallwork.door_boxes(arcs, evidence).select("seq", "orient", "x0", "y0", "x1", "y1")


_PICTURES = [(1, 6000, 4000, 230.0, 250.0, 90.0, 0.05), (2, 1000, 800, 230.0, 250.0, 90.0, 0.05), (3, 3000, 2000, 60.0, 200.0, 90.0, 0.05), (4, 3000, 2000, 230.0, 250.0, 10.0, 0.4), (5, 3000, 200, 230.0, 250.0, 90.0, 0.05), (6, 3000, 2000, 230.0, 250.0, 90.0, 0.0001)]


def geo_picture_checks(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, _PICTURES, "plan_id long, width int, height int, median double, light double, blur double, ink double")
    return wallwork.picture_checks(d).select("plan_id", F.round("factor", 4).alias("factor"), "inverted", F.array_join("warnings", "; ").alias("warnings"), "error")


def geo_picture_stats(spark: SparkSession, _: str) -> DataFrame:
    g = np.full((20, 20), 200, np.uint8)
    g[:, 10:] = 100
    return pixels.picture_stats(_masks(spark, g)).select("plan_id", "width", "height", "median", "light", (F.col("blur") > 40).alias("sharp"))


def geo_ocr_scale(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, [(1, 6400, 3000), (2, 1000, 900), (3, 3100, 100), (4, 3300, 1)], "i long, w int, h int")
    return d.select("i", wallwork.ocr_scale(F.col("w"), F.col("h")).alias("k"))


_SIDES = [(1, s, 0.9) for s in range(4)] + [(2, s, 0.9 if s else 0.5) for s in range(4)]


def geo_stamp_frames(spark: SparkSession, _: str) -> DataFrame:
    return wallwork.stamp_frames(_rows(spark, [(1, *r) for r in _SIDES], "plan_id long, seq long, side int, ink double")).select("seq")


def geo_warnings(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, [(1, ["b", None, "a", "b", "c", "a"]), (2, [])], "i long, w array<string>")
    return d.select("i", F.array_join(wallwork.warnings_of(F.col("w")), ",").alias("warnings"))


def _with(**tables: str) -> str:
    return "with " + ", ".join(f"{n} as ({q})" for n, q in tables.items()) + " "


# -- results, perspective, jobs


def geo_envelopes(spark: SparkSession, _: str) -> DataFrame:
    rows = [(1, "<svg/>", ["b", "a", "b"], {"WALLS": 4}, "1:100", "mm", 10, 20, (4, 2), None, None), (2, "<svg/>", None, {}, None, "px", 10, 20, None, "no scale", None), (3, None, None, None, None, None, None, None, None, None, "unsupported file type: txt")]
    df = _rows(spark, rows, "plan_id long, svg string, warnings array<string>, layers map<string,int>, scale_note string, unit string, width int, height int, summary struct<walls:int,doors:int>, model_error string, error string")
    j = lambda path: F.get_json_object("json", path)
    return results.envelopes(df).select("plan_id", j("$.ok").alias("ok"), j("$.warnings").alias("warnings"), j("$.layers.WALLS").alias("walls"), j("$.bim.available").alias("model"), F.coalesce(j("$.bim.reason"), j("$.detail")).alias("reason"), j("$.bim.summary.doors").alias("doors"))


def geo_loaded(spark: SparkSession, _: str) -> DataFrame:
    df = _rows(spark, [(1, 3600, 2000, 1, None), (2, 900, 500, 1, None), (3, None, None, None, "empty file")], "plan_id long, width int, height int, pages int, error string")
    return results.loaded(df)


def geo_obj(spark: SparkSession, _: str) -> DataFrame:
    """Counts, the outermost corners, and that all faces name corners of their own box."""
    rects, openings, plans = _model(spark)
    w, o = bim.walls(rects, plans), bim.opening_details(openings, rects, plans)
    pieces = bim.wall_boxes(w, o, 2.5)
    lines = results.obj(w, pieces).select("plan_id", F.posexplode(F.split("obj", "\n")).alias("i", "line"))
    kind = F.substring("line", 1, 2)
    top = F.max(F.when(kind == "v ", F.split("line", " ")[2].cast("double")))
    last = F.max(F.when(kind == "f ", F.array_max(F.transform(F.slice(F.split("line", " "), 2, 4), lambda x: x.cast("long")))))
    n = lambda k: F.count_if(kind == k)
    return lines.groupBy("plan_id").agg(n("v ").alias("corners"), n("f ").alias("faces"), n("o ").alias("parts"), top.alias("top"), last.alias("last_corner"))


def geo_title_block(spark: SparkSession, _: str) -> DataFrame:
    df = _rows(spark, [(1, "file", "Grundriss " + "x" * 80, 100, "from dimensions", "2024-03-09"), (2, "file", None, None, None, "2024-12-01")], "plan_id long, title string, plan_title string, scale int, scale_note string, date string")
    return results.title_block(df.withColumn("date", F.to_date("date"))).select("plan_id", F.array_join("lines", "|").alias("lines"))


def geo_scale_bar(spark: SparkSession, _: str) -> DataFrame:
    df = _rows(spark, [(100, 1.0), (50, 2.0)], "scale int, step double").select("scale", F.inline(results.scale_bar(F.col("scale"), F.col("step"), F.lit(10.0))))
    return df.select("scale", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "filled")


def geo_measured_errors(spark: SparkSession, _: str) -> DataFrame:
    box = "plan_id long, kind string, seq long, width double"
    predicted = _rows(spark, [(1, "door", 1, 90.0), (1, "door", 2, 100.0), (1, "window", 1, 50.0)], box)
    truth = _rows(spark, [(1, "door", 7, 95.0, 10.0), (1, "door", 8, 90.0, 10.0), (1, "window", 9, 50.0, 10.0)], box + ", wall_px double")
    matched = _rows(spark, [(1, "door", 1, 7), (1, "door", 2, 8), (1, "window", 1, 9)], "plan_id long, kind string, seq long, truth_seq long")
    return evaluate.measured_errors(matched, predicted, truth)


_ANGLES = [(1, 10.0, 9.0), (2, 89.5, 0.5), (3, None, 3.0), (4, -44.0, 45.0)]


def geo_angle_errors(spark: SparkSession, _: str) -> DataFrame:
    return evaluate.angle_errors(_rows(spark, _ANGLES, "plan_id long, found double, truth double"))


def _seen(matrix: np.ndarray) -> list[tuple]:
    """A grid of wall edges as a camera of the given homography sees it."""
    see = lambda x, y: (lambda v: (float(v[0] / v[2]), float(v[1] / v[2])))(matrix @ [x, y, 1.0])
    grid = range(100, 901, 100)
    return [(1, i, *see(*a), *see(*b)) for i, (a, b) in enumerate([((100, k), (900, k)) for k in grid] + [((k, 100), (k, 900)) for k in grid])]


def geo_perspective(spark: SparkSession, _: str) -> DataFrame:
    """After the correction, edges that were parallel are parallel to the axes again."""
    camera = np.array([[1.0, 0.05, 0.0], [0.02, 1.0, 0.0], [1e-4, 6e-5, 1.0]])
    rows = _rows(spark, _seen(camera), "plan_id long, seq long, x1 double, y1 double, x2 double, y2 double")
    found = perspective.corrections(rows, _rows(spark, [(1, 1000.0, 1000.0)], "plan_id long, width double, height double"))
    at = lambda x, y: S.homography(F.col("matrix"), F.col(x), F.col(y))
    out = rows.join(found, "plan_id").select("plan_id", "convergence", at("x1", "y1").alias("p"), at("x2", "y2").alias("q"))
    slant = F.least(F.abs(F.col("p.x") - F.col("q.x")), F.abs(F.col("p.y") - F.col("q.y"))) / F.hypot(F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y"))
    return out.groupBy("plan_id").agg((F.max(slant) < 0.002).alias("straight"), (F.max("convergence") > 0.8).alias("was_bent"), F.count("*").alias("n"))


def geo_jobs(spark: SparkSession, _: str) -> DataFrame:
    plans = _rows(spark, [("train", i, 100 + i) for i in range(5)] + [("val", i, 200 + i) for i in range(3)], "split string, pos long, idx long")

    def made(idx: int, seed: int) -> dict | None:
        if idx == 101:
            raise ValueError("no outline")
        return None if idx == 102 else {"wall_px": idx / 10}

    return jobs.run_jobs(jobs.jobs(spark, {"train": 7, "val": 2}, plans), made)


_NAMES = [n for n in list(globals()) if n.startswith("geo_")]
QUERIES = {n: globals()[n] for n in _NAMES}


_LONG = "Grundriss " + "x" * 50

ORACLE_SQL = {
    "geo_envelopes": _sql("plan_id, ok, warnings, walls, model, reason, doors", [(1, "true", '["b","a"]', "4", "true", None, "2"), (2, "true", "[]", None, "false", "no scale", None), (3, "false", None, None, None, "unsupported file type: txt", None)]),
    "geo_loaded": _sql("plan_id, json", [(1, '{"ok":true,"width":3600,"height":2000,"pages":1,"preview":[1800,1000]}'), (2, '{"ok":true,"width":900,"height":500,"pages":1,"preview":[900,500]}'), (3, '{"ok":false,"detail":"empty file"}')]),
    "geo_obj": _sql("plan_id, corners, faces, parts, top, last_corner", [(1, 96, 72, 12, 2.5, 96)]),
    "geo_title_block": _sql("plan_id, lines", [(1, f"{_LONG}|Massstab 1:100 (A3)|Datum 09.03.2024|from dimensions"), (2, "file|unmassstäblich|Datum 01.12.2024|")]),
    "geo_scale_bar": "select s as scale, round(10 + i * step * 1000 / s * 72 / 25.4, 3) as a, round(10 + (i + 1) * step * 1000 / s * 72 / 25.4, 3) as b, i % 2 = 0 as filled from (values (100, 1.0), (50, 2.0)) t(s, step), range(5) r(i)",
    "geo_measured_errors": _sql("kind, n, width_error", [("door", 2, 0.75), ("window", 1, 0.0)]),
    "geo_angle_errors": _with(a=_sql("plan_id, found, truth", _ANGLES)) + "select count(*) as n, round(avg(e), 3) as mean, round(max(e), 3) as most from (select abs((((found - truth + 45) % 90) + 90) % 90 - 45) as e from a where found is not null and truth is not null)",
    "geo_perspective": _sql("plan_id, straight, was_bent, n", [(1, True, True, 18)]),
    "geo_jobs": """with k as (select 'train' as split, i as k, i as seed, (i * 7919) % 5 as pos, 100 as base from range(7) r(i) union all select 'val', i, 5000000 + i, (i * 7919) % 3, 200 from range(2) r(i))
        select split, base + pos as idx, seed, case when base + pos <> 101 then lpad(cast(seed as varchar), 7, '0') end as name, case when base + pos <> 101 then (base + pos) / 10.0 end as wall_px,
        case when base + pos = 101 then 'ValueError(''no outline'')' end as error from k where base + pos <> 102""",
    "geo_binarized": _sql("plan_id, digits", [(1, 560)]),
    "geo_rooms": _sql("plan_id, label, area, \"left\"", [(1, 1, 660, 13), (1, 2, 660, 41)]),
    "geo_boxes": _sql("orient, x0, y0, x1, y1", [("h", 8.0, 8.0, 68.0, 12.0), ("h", 8.0, 44.0, 20.0, 48.0), ("h", 28.0, 44.0, 68.0, 48.0), ("v", 8.0, 12.0, 12.0, 44.0), ("v", 36.0, 12.0, 40.0, 44.0), ("v", 64.0, 12.0, 68.0, 44.0)]),
    "geo_vectors": _sql("orient, tens, wide", [("h", 50.0, True), ("h", 50.0, True), ("v", 20.0, True)]),
    "geo_arc": _sql("what, cx, cy, r, start, stop", [("quarter", 50.0, 40.0, 30.0, 0.0, 90.0), ("circle", 50.0, 40.0, 30.0, 0.0, 360.0), ("line", 0.0, 0.0, 0.0, 0.0, 0.0)]),
    "geo_stroke": _sql("plan_id, stroke", [(1, 3.0)]),
    "geo_squared": _sql("seq, x0, y0, x1, y1", [(1, 0.0, 0.0, 111.0, 10.0), (2, 101.0, 0.0, 111.0, 80.0), (3, 3.0, 40.0, 106.0, 46.0), (4, 300.0, 0.0, 310.0, 80.0)]),
    "geo_straightened": _sql("i, ring", [(1, "0.0 0.5,100.5 0.5,100.5 60.0,0.0 60.0"), (2, "0.0 0.0,10.0 10.0")]),
    "geo_readable": _sql("seq, text", [(1, "Bad"), (5, "Wohnen")]),
    "geo_door_boxes": _sql("seq, orient, x0, y0, x1, y1", [(1, "v", 97.0, 50.0, 103.0, 92.0), (2, "h", -20.0, 6.0, 10.0, 12.0)]),
    "geo_picture_stats": _sql("plan_id, width, height, median, light, sharp", [(1, 20, 20, 150.0, 200.0, True)]),
    "geo_footprint": _sql("plan_id, area, top, \"right\"", [(1, 2400, 8, 67)]),
    "geo_thickness": _sql("plan_id, thickness", [(1, 4.0)]),
    "geo_external": _with(r=_sql(_RECT_COLUMNS, _RECTS)) + "select seq, orient = 'h' as external from r",
    "geo_gaps": _with(r=_sql(_RECT_COLUMNS, _RECTS))
    + """select a.orient, a.x1 as x0, a.y0, b.x0 as x1, a.y1, a.seq as after from r a join r b on a.orient = 'h' and b.seq <> a.seq and b.x0 - a.x1 between 2 and 40
        and least((a.y0 + a.y1) / 2 + 1.3 * (a.y1 - a.y0) / 2, b.y1) - greatest((a.y0 + a.y1) / 2 - 1.3 * (a.y1 - a.y0) / 2, b.y0) >= 0.45 * 1.3 * (a.y1 - a.y0)
        qualify row_number() over (partition by a.seq order by b.x0, b.seq) = 1""",
    "geo_joined_gaps": _sql("orient, seq, x0, y0, x1, y1", [("h", 0, 0.0, 0.0, 11.0, 14.0), ("h", 1, 30.0, 0.0, 40.0, 4.0), ("v", 0, 0.0, 0.0, 10.0, 4.0)]),
    "geo_gap_kind": _with(g=_sql(_GAP_COLUMNS, _GAPS))
    + """select seq, case when length < 1.5 * t then 'wall' when (lines >= 1 and outside) or lines >= 2 then 'window' when outside and window_share > 0.3 then 'window'
        when swing then 'door' when window_share + door_share > 0.2 then (case when outside and window_share > door_share then 'window' else 'door' end)
        when length < 2.5 * t then 'wall' end as kind from g""",
    "geo_filled_walls": _with(f=_sql("plan_id, wall, fill, both_px", _FILLS)) + "select plan_id, wall > 0 and fill >= 0.4 * wall and both_px >= 0.7 * wall and both_px >= 0.6 * fill as filled from f",
    "geo_opening_orients": _with(f=_sql(_FOUND_COLUMNS, _FOUND))
    + "select seq, case when left_wall + right_wall >= above + below then 'h' else 'v' end as orient from f where greatest(left_wall + right_wall, above + below) >= 0.15 or greatest(x1 - x0, y1 - y0) >= 8",
    "geo_swings": _with(c=_sql("seq, side, hinge, arc, leaf", _SWINGS), s="select *, (case when arc >= 0.5 then 0.7 * arc + 0.3 * leaf else 0 end) - (case hinge when 'both' then 0.03 else 0 end) as score from c")
    + "select seq, side, hinge, round(score, 4) as score from s qualify row_number() over (partition by seq order by round(score, 9) desc, side, case hinge when 'start' then 0 when 'end' then 1 else 2 end) = 1 and score >= 0.42",
    "geo_edges": _with(p=_sql("seq, at_px, d, inner_ink, outer_ink", _PROFILES), s="select *, round(inner_ink - outer_ink - 0.02 * abs(d), 9) as s from p")
    + "select seq, case when s > 0.25 then at_px + d else at_px end as at from s qualify row_number() over (partition by seq order by s desc, d) = 1",
    "geo_dashes": _with(s=_sql("line, i, v", _SAMPLES), g="select line, i, i - row_number() over (partition by line order by i) as run from s where v")
    + "select line, min(i) as start, max(i) + 1 as \"end\" from g group by line, run",
    "geo_nearest_dash": _sql("line, start, \"end\"", [(1, 6, 7), (2, 0, 9)]),
    "geo_partners": _with(
        l=_sql("seq, x1, y1, x2, y2", _WALL_LINES),
        g="select seq, y1 = y2 as flat, case when y1 = y2 then y1 else x1 end as at, case when y1 = y2 then least(x1, x2) else least(y1, y2) end as a0, case when y1 = y2 then greatest(x1, x2) else greatest(y1, y2) end as a1 from l",
    )
    + """select a.seq, b.seq as partner, greatest(a.a0, b.a0) as lo, least(a.a1, b.a1) as hi, least(a.at, b.at) as f0, greatest(a.at, b.at) as f1
        from g a join g b on a.flat = b.flat and a.seq <> b.seq and abs(a.at - b.at) between 5 and 25 and least(a.a1, b.a1) - greatest(a.a0, b.a0) >= 0.3 * least(a.a1 - a.a0, b.a1 - b.a0)
        qualify row_number() over (partition by a.seq order by abs(a.at - b.at), b.seq) = 1""",
    "geo_alike_heights": _with(h=_sql("seq, h", _HEIGHTS)) + "select a.seq, median(b.h) as cap from h a join h b on b.h > a.h / 1.2 and b.h < a.h * 1.2 group by a.seq",
    "geo_text_heights": _sql("plan_id, text_h", [(1, 14.0), (2, 18.0)]),
    "geo_open_rooms": _with(c=_sql("seq, x, y", _CENTRES)) + "select seq, 1 as label from c where x < 50 and y < 40 union all select seq, -row_number() over (order by seq) from c where x between 50 and 99 and y < 40",
    "geo_picture_checks": _with(p=_sql("plan_id, width, height, med, light, blur, ink", _PICTURES), q="select *, greatest(width, height) as side from p")
    + """select plan_id, round(case when side > 4500 then 4500 / side when side < 1800 then 1800 / side else 1 end, 4) as factor, med < 110 and light > 150 as inverted,
        array_to_string(list_filter([case when side < 1800 or blur < 40 or ink > 0.3 then 'low quality' end, case when med < 110 and light > 150 then 'light lines on dark ground' end], lambda x: x is not null), '; ') as warnings,
        case when least(width, height) < 300 then 'the picture is too small' when ink < 0.0005 then 'no lines were found' end as error from q""",
    "geo_ocr_scale": _sql("i, k", [(1, 0.5), (2, 2.0), (3, 1.0), (4, 1.0)]),
    "geo_stamp_frames": _with(s=_sql("seq, side, ink", _SIDES)) + "select seq from s group by seq having count(*) filter (ink >= 0.85) = 4",
    "geo_warnings": _sql("i, warnings", [(1, "b,a,c"), (2, "")]),
}
