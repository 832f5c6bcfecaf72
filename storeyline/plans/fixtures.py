"""``geo_*``: the plan operators on literal rows, with the rows or rules as oracle SQL.

The fixtures are small plans in metres and pixels whose results can be read off. Where an operator
is a fold or a fixpoint its oracle is the list of rows that follow from the fixture."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeyline.functions import scalars as S
from storeyline.operators import bim, classify, cleanup, evaluate, ocr, openings, raster, scale, stamps
from storeyline.operators.helpers import consensus
from storeyline.sinks import drawing, ifc
from storeyline.sources import readers
from storeyline.sources.schemas import ARCS, LINES, OPENINGS, RECTS, STOREYS


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql(columns: str, rows: list) -> str:
    def one(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"cast({v!r} as double)"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


# -- OCR: the plan's scale from a table of words

TSV = "\n".join("\t".join(map(str, r)) for r in [
    ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"),
    (5, 1, 1, 1, 1, 1, 100, 100, 150, 30, 91.0, "Grundriss"), (5, 1, 1, 1, 1, 2, 265, 100, 40, 30, 90.0, "EG"),
    (5, 1, 2, 1, 1, 1, 100, 300, 22, 30, 93.0, "M"), (5, 1, 2, 1, 1, 2, 135, 300, 90, 30, 88.0, "1:100"),
    (5, 1, 2, 1, 1, 3, 600, 300, 90, 30, 95.0, "1:50"), (5, 1, 3, 1, 1, 1, 100, 500, 90, 30, 59.0, "1:20"),
    (5, 1, 3, 1, 1, 2, 200, 500, 20, 30, 84.0, "x"), (5, 1, 3, 1, 1, 3, 300, 500, 20, 30, 85.0, "7"),
    (5, 1, 4, 1, 1, 1, "bad", 500, 20, 30, 85.0, "lost"), (5, 1, 4, 1),
])


def _ocr_lines(spark: SparkSession) -> DataFrame:
    words = readers.ocr_words(_rows(spark, [(1, 0, TSV), (1, 90, TSV.splitlines()[1])], "plan_id long, rotation int, tsv string"))
    return ocr.text_lines(words, _rows(spark, [(1, 2.0, 2000, 1200.0)], "plan_id long, k double, ocr_height int, short double"))


def geo_ocr_lines(spark: SparkSession, _: str) -> DataFrame:
    return ocr.without_doubles(_ocr_lines(spark)).select("plan_id", "rotation", "text", "x0", "y0", "x1", "y1", F.round("conf", 2).alias("conf"))


def geo_scale(spark: SparkSession, _: str) -> DataFrame:
    """The first real question: what is this plan's scale? 1:100 at 300 dpi is 8.4667 mm a pixel."""
    ratio = scale.scale_ratio(_ocr_lines(spark))
    plans = _rows(spark, [(1, None, 300.0, 1.0, False)], "plan_id long, calibrated_mm_px double, dpi double, resize_factor double, warped boolean")
    none = _rows(spark, [], "plan_id long, mm_per_px double")
    out = scale.ladder(plans, none, ratio, none, none)
    return out.join(ratio, "plan_id").select("plan_id", "ratio", F.round("mm_per_px", 4).alias("mm_per_px"), "source")


DIMENSION_TEXTS = ["4.50", "4,50", "80", "4.5", "12.345", "3⁵", "0.01", " 1 20 ", "61", "60.01", "abc", "", "1234"]


def geo_dimparse(spark: SparkSession, _: str) -> DataFrame:
    return _rows(spark, [(i, t) for i, t in enumerate(DIMENSION_TEXTS)], "i long, text string").select("i", S.dimension_mm("text").alias("mm"), S.is_numeric_token("text").alias("numeric"))


def geo_scale_texts(spark: SparkSession, _: str) -> DataFrame:
    texts = ["M 1:100", "Massstab 1/50 und 1:33", "MASSSTAB 1:200", "1 : 500", "12:100", "keiner", "Scale. 1:20"]
    return _rows(spark, list(enumerate(texts)), "i long, text string").select("i", F.array_join(S.scale_ratios("text"), ",").alias("ratios"), S.scale_prefixed("text").alias("prefixed"))


STAMP_TEXTS = [("O02 Kuche", 80.0), ("F 12,5", 90.0), ("20.3 m2", 90.0), ("12.50", 70.0), ("Zimmer", 54.0), ("Wohnen", 60.0), ("002", 90.0), ("BF=7.25", 90.0), ("3 qm", 40.0), ("W 1", 99.0)]


def geo_stamp_texts(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, [(i, t, c) for i, (t, c) in enumerate(STAMP_TEXTS)], "i long, text string, conf double")
    n = S.number_prefix(S.stamp_line("text"))
    return d.select("i", S.stamp_line("text").alias("line"), S.area_m2("text").alias("area"), S.has_area_mark("text").alias("marked"), S.is_name("text", "conf").alias("named"), n["number"].alias("number"))


def geo_area_fix(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, [(0, 235.5, 25.4), (1, 20.3, 20.0), (2, 12.345, 12.0), (3, 117.0, 17.0)], "i long, v double, measured double")
    return d.select("i", S.area_text("v").alias("text"), S.digit_drops(F.col("v"), F.col("measured")).alias("fixed"))


_VALUES = [(k, v) for k, x in {1: [10.0, 10.2, 9.9, 20.0], 2: [10.0, 10.2], 3: [1.0, 2.0, 3.0, 4.0, 5.0], 4: [5.0], 5: [10.0, 20.0, 20.3, 40.0]}.items() for v in x]


def geo_consensus(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, _VALUES, "plan_id long, v double")
    return consensus(d, ["plan_id"], "v").select("plan_id", "n", F.round("value", 4).alias("value"))


def geo_scale_ladder(spark: SparkSession, _: str) -> DataFrame:
    plans = _rows(spark, [(1, 5.0, 300.0, 1.0, False), (2, None, 300.0, 1.0, False), (3, None, 300.0, 0.5, False), (4, None, 300.0, 1.0, True), (5, None, None, 1.0, False), (6, None, None, 1.0, False)], "plan_id long, calibrated_mm_px double, dpi double, resize_factor double, warped boolean")
    chains = scale.chain_scale(_rows(spark, [(2, 8.0), (2, 8.1), (2, 8.2)], "plan_id long, mm_per_px double"))
    ratios = _rows(spark, [(3, 100)], "plan_id long, ratio int")
    rooms = scale.room_scale(_rows(spark, [(4, 16.0, 250000.0), (4, 9.0, 140625.0), (5, 4.0, 1.0)], "plan_id long, area_m2 double, area_px double"))
    doors = scale.door_scale(_rows(spark, [(5, 100.0), (5, 101.0), (5, 99.0), (5, 300.0), (6, 90.0)], "plan_id long, width double"))
    return scale.ladder(plans, chains, ratios, rooms, doors).select("plan_id", F.round("mm_per_px", 6).alias("mm_per_px"), "source")


# -- lines: two walls by faces with caps, a hatch, a stair, a dimension chain, a door

_PLAN = [
    (1, 100.0, 100.0, 700.0, 100.0, 2.0), (2, 100.0, 130.0, 700.0, 130.0, 2.0), (3, 100.0, 100.0, 100.0, 130.0, 2.0), (4, 700.0, 101.0, 700.0, 129.0, 2.0),
    (5, 100.0, 300.0, 700.0, 300.0, 2.0), (6, 450.0, 320.0, 900.0, 320.0, 2.0), (7, 100.0, 900.0, 400.0, 900.0, 2.0),
    *((10 + i, 800.0, 500.0 + 20 * i, 860.0, 500.0 + 20 * i, 2.0) for i in range(6)),
    *((20 + i, 300.0 + 8 * i, 700.0, 320.0 + 8 * i, 720.0, 2.0) for i in range(6)),
    (30, 150.0, 600.0, 150.0, 690.0, 2.0), (31, 900.0, 100.0, 905.0, 200.0, 9.0),
]


def _lines(spark: SparkSession) -> DataFrame:
    return _rows(spark, [(1, s, *map(float, xy), "LINES", w, 1) for s, *xy, w in _PLAN], LINES)


def _frame(spark: SparkSession) -> DataFrame:
    return _rows(spark, [(1, 1000.0, 2.0, 14.0, None)], "plan_id long, short double, thin_w double, text_h double, mm_per_px double")


def geo_pairs(spark: SparkSession, _: str) -> DataFrame:
    return classify.face_pairs(_lines(spark), _frame(spark)).select("plan_id", F.col("seq").alias("seq_a"), F.col("b_seq").alias("seq_b"))


def geo_hatch(spark: SparkSession, _: str) -> DataFrame:
    return classify.hatch(_lines(spark), _frame(spark))


def geo_stairs(spark: SparkSession, _: str) -> DataFrame:
    return classify.stairs(_lines(spark), _frame(spark))


_THICK = [(1, 0.0, 0.0, 100.0, 0.0, 3.6), (2, 0.0, 10.0, 100.0, 10.0, 3.5), (3, 0.0, 20.0, 24.0, 20.0, 9.0), (4, 0.0, 30.0, 100.0, 60.0, 9.0), (5, 50.0, 0.0, 50.0, 90.0, 5.0)]


def geo_thick_walls(spark: SparkSession, _: str) -> DataFrame:
    """Long axis lines of 1.8 thin widths; not the thin, the short, the slanted one."""
    return classify.thick_walls(_rows(spark, [(1, *r[:5], "LINES", r[5], 1) for r in _THICK], LINES), _frame(spark)).select("seq")


def geo_window_lines(spark: SparkSession, _: str) -> DataFrame:
    """A window's two lines between the heads of two walls; a third line touches one of them only."""
    rows = [(1, 100.0, 100.0, 100.0, 130.0, "WALLS"), (2, 180.0, 100.0, 180.0, 130.0, "WALLS"), (3, 100.0, 110.0, 180.0, 110.0, "LINES"), (4, 100.0, 120.0, 180.0, 120.0, "LINES"), (5, 100.0, 128.0, 150.0, 128.0, "LINES"), (6, 300.0, 110.0, 380.0, 110.0, "LINES")]
    return classify.windows(_rows(spark, [(1, *r, 2.0, 1) for r in rows], LINES), _frame(spark)).select("seq")


def geo_classify(spark: SparkSession, _: str) -> DataFrame:
    arcs = _rows(spark, [(1, 1, 150.0, 690.0, 90.0, 270.0, 360.0, None), (1, 2, 500.0, 500.0, 400.0, 0.0, 90.0, None)], ARCS)
    texts = _rows(spark, [(1, 1, "3.00", 236.0, 880.0, 264.0, 894.0, 0)], "plan_id long, seq long, text string, x0 double, y0 double, x1 double, y1 double, rotation int")
    marks = _rows(spark, [(1, 40, 100.0, 890.0, 100.0, 910.0, "LINES", 2.0, 1), (1, 41, 400.0, 890.0, 400.0, 910.0, "LINES", 2.0, 1)], LINES)
    parts = _rows(spark, [(1, 1, 900.0)], "plan_id long, comp int, diag double")
    done = classify.classify(_lines(spark).unionByName(marks), arcs, texts, parts, _frame(spark))
    rows = done["lines"].select(F.lit("line").alias("kind"), "seq", "layer", F.lit(None).cast("double").alias("mm_per_px"))
    rows = rows.unionByName(done["arcs"].select(F.lit("arc").alias("kind"), "seq", "layer", F.lit(None).cast("double").alias("mm_per_px"))).unionByName(done["texts"].select(F.lit("text").alias("kind"), "seq", "layer", F.lit(None).cast("double").alias("mm_per_px")))
    return rows.unionByName(done["scales"].select(F.lit("scale").alias("kind"), "seq", F.lit(None).cast("string").alias("layer"), "mm_per_px"))


_RAGGED = [(1, 0.0, 0.0, 100.0, 1.0), (2, 104.0, 0.5, 200.0, 0.5), (3, 204.0, 2.0, 204.0, 150.0), (4, 0.0, 100.0, 198.0, 100.0), (5, 150.0, 3.0, 152.0, 6.0), (6, 300.0, 300.0, 300.0, 302.0), (7, 50.0, 1.0, 55.0, 99.0), (8, 60.0, 40.0, 90.0, 70.0)]


def geo_cleanup(spark: SparkSession, _: str) -> DataFrame:
    lines = _rows(spark, [(1, s, *xy, "LINES", 2.0, 1) for s, *xy in _RAGGED], LINES)
    out = cleanup.clean(lines, 1.5, 6.0, 6.0, 5.0)
    return out.select("seq", *(F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")))


_BRIDGED = [(1, 0.0, 0.0, 100.0, 0.0), (2, 0.0, 20.0, 100.0, 20.0), (3, 10.0, 1.0, 14.0, 19.0), (4, 10.0, 1.0, 14.0, 40.0), (5, 200.0, 1.0, 204.0, 19.0)]


def geo_bridges(spark: SparkSession, _: str) -> DataFrame:
    lines = _rows(spark, [(1, s, *xy, "LINES", 2.0, 1) for s, *xy in _BRIDGED], LINES)
    return cleanup.drop_bridges(lines, 25.0, 2.0).select("seq")


# -- rooms and stamps


def _rooms(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    runs = _rows(spark, [(1, 1, y, 0, 199) for y in range(0, 200)] + [(1, 2, y, 210, 499) for y in range(0, 200)], "plan_id long, label long, y int, xa int, xb int")
    texts = [("01", 20, 24, 90.0), ("Kuche", 20, 40, 80.0), ("Parkett", 20, 54, 80.0), ("16.0 m2", 20, 70, 90.0), ("Wohnen", 260, 40, 90.0), ("235.2 m²", 260, 62, 90.0), ("fern", 260, 180, 90.0), ("draussen", 600, 40, 90.0)]
    return runs, _rows(spark, [(1, i, t, float(x), float(y), float(x + 60), float(y + 14), c) for i, (t, x, y, c) in enumerate(texts)], "plan_id long, seq long, text string, x0 double, y0 double, x1 double, y1 double, conf double")


def geo_room_names(spark: SparkSession, _: str) -> DataFrame:
    runs, texts = _rooms(spark)
    return stamps.room_names(texts, runs)


def geo_stamps(spark: SparkSession, _: str) -> DataFrame:
    runs, texts = _rooms(spark)
    held = texts.join(stamps.room_of_text(texts, runs), ["plan_id", "seq"])
    rooms = _rows(spark, [(1, 1, 40000.0, 20.0), (1, 2, 58000.0, 20.0)], "plan_id long, label long, area_px double, mm_per_px double")
    return stamps.stamps(held, rooms)


# -- building model

_RECTS = [(1, 0.0, 0.0, 1200.0, 30.0, "h"), (2, 0.0, 0.0, 30.0, 800.0, "v"), (3, 500.0, 30.0, 512.0, 800.0, "v"), (4, 600.0, 10.0, 700.0, 20.0, "h")]
_OPENINGS = [(1, "window", 120.0, 0.0, 320.0, 30.0, "h"), (2, "door", 500.0, 200.0, 512.0, 290.0, "v"), (3, "door", 900.0, 400.0, 990.0, 412.0, "h"), (4, "window", 620.0, 5.0, 690.0, 25.0, "h"), (5, "door", 500.0, 600.0, 512.0, 620.0, "v")]


def _model(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    rects = _rows(spark, [(1, *r) for r in _RECTS], RECTS).withColumn("external", F.col("seq") < 3)
    openings = _rows(spark, [(1, *r) for r in _OPENINGS], OPENINGS)
    plans = _rows(spark, [(1, 10.0, 1000.0, "chain", True, 0.2, 2.5, 2.0, 1.2, 0.9)], "plan_id long, mm_per_px double, height double, scale_source string, auto_thickness boolean, default_thickness double, wall_height double, door_height double, window_height double, sill_height double")
    return rects, openings, plans


def geo_host(spark: SparkSession, _: str) -> DataFrame:
    rects, openings, _p = _model(spark)
    return bim.hosts(openings, rects)


def geo_walls(spark: SparkSession, _: str) -> DataFrame:
    rects, _o, plans = _model(spark)
    return bim.wall_names(bim.walls(rects, plans)).select("seq", "name", "external", F.round("length", 4).alias("length"), "thickness", F.col("start.x").alias("sx"), F.col("start.y").alias("sy"))


def geo_openings(spark: SparkSession, _: str) -> DataFrame:
    rects, openings, plans = _model(spark)
    return bim.opening_names(bim.opening_details(openings, rects, plans)).select("seq", "host", "name", *(F.round(c, 4).alias(c) for c in ("offset", "width", "height", "sill")))


_ROOMS = [(1, 1, None, 30, 30, 36.19), (1, 2, "Küche", 30, 520, 52.0), (1, 3, None, 400, 30, 10.0)]


def _model_rooms(spark: SparkSession) -> DataFrame:
    return bim.room_titles(_rows(spark, _ROOMS, "plan_id long, label long, name string, top int, left int, area double"))


def geo_summary(spark: SparkSession, _: str) -> DataFrame:
    rects, openings, plans = _model(spark)
    return bim.summary(bim.walls(rects, plans), bim.opening_details(openings, rects, plans), _model_rooms(spark))


def geo_room_titles(spark: SparkSession, _: str) -> DataFrame:
    return _model_rooms(spark).select("label", "name")


def geo_model_json(spark: SparkSession, _: str) -> DataFrame:
    rects, openings, plans = _model(spark)
    out = bim.model_json(bim.wall_names(bim.walls(rects, plans)), bim.opening_names(bim.opening_details(openings, rects, plans)), _model_rooms(spark), _rows(spark, [(1, 0.0)], "plan_id long, elevation double"))
    return out.select("plan_id", F.get_json_object("json", "$.walls[0].name").alias("first_wall"), F.get_json_object("json", "$.walls[0].openings[0].width").cast("double").alias("width"), F.get_json_object("json", "$.spaces[1].name").alias("second_space"), F.json_array_length(F.get_json_object("json", "$.walls")).cast("long").alias("n_walls"))


def geo_wall_boxes(spark: SparkSession, _: str) -> DataFrame:
    rects, openings, plans = _model(spark)
    return bim.wall_boxes(bim.walls(rects, plans), bim.opening_details(openings, rects, plans), 2.5).select("seq", "kind", *(F.round(c, 4).alias(c) for c in ("a", "b", "bottom", "top")))


def geo_storeys(spark: SparkSession, _: str) -> DataFrame:
    table = _rows(spark, [(1, 0, "UG", 2.5), (1, 1, "EG", 2.8), (1, 2, "OG", 2.8), (2, 0, "A", 3.0), (3, 0, "1OG", 2.7), (3, 1, "DG", 2.4)], STOREYS)
    texts = _rows(spark, [(1, 1, "OG Bad"), (1, 2, "Grundriss Erdgeschoss"), (2, 1, "Dachgeschoss"), (3, 1, "Plan 1. OG")], "plan_id long, seq long, text string")
    wanted = _rows(spark, [(1, "auto"), (2, "auto"), (3, "DG")], "plan_id long, plan_storey string")
    return bim.storeys(table, bim.detected_storeys(texts), wanted)


def geo_settings(spark: SparkSession, _: str) -> DataFrame:
    raw = [(1, json.dumps({"wall_height": "2,40", "sill_height": "abc", "storeys": [{"name": "", "height": 2}, {"name": "EG", "height": "3,1"}, {"name": "EG", "height": 9}, {"name": "OG", "height": 99}], "plan_storey": "XX"})), (2, "{}"), (3, "no json"), (4, json.dumps({"wall_height": 2.7, "storeys": [{"name": "OG", "height": 2.6}], "plan_storey": "OG", "auto_thickness": False}))]
    s = readers.settings(_rows(spark, raw, "plan_id long, json string"))
    return s.select("plan_id", "wall_height", "sill_height", "auto_thickness", F.array_join(F.transform("storeys", lambda r: F.concat_ws("=", r["name"], r["height"].cast("string"))), ",").alias("storeys"), "plan_storey")


def geo_calibration(spark: SparkSession, _: str) -> DataFrame:
    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    raw = [(1, '{"p1":[0.1,0.5],"p2":[0.6,0.5],"length_m":5}', one), (2, '{"p1":[0.1,0.5],"p2":[0.105,0.5],"length_m":5}', one), (3, '{"p1":[0.1,0.5],"p2":[0.6,0.5],"length_m":0}', one), (4, '{"p1":[0,0],"p2":[1,0],"length_m":4}', [2.0, 0.0, 5.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0])]
    d = _rows(spark, [(i, j, 1000.0, 800.0, m) for i, j, m in raw], "plan_id long, json string, width double, height double, matrix array<double>")
    return readers.calibration(d)


def geo_stairs_steps(spark: SparkSession, _: str) -> DataFrame:
    p = "struct<x:double,y:double>"
    edges = _rows(spark, [(1, 1, i, 0.27 * i, {"x": 0.0, "y": 0.27 * i}, {"x": 1.2, "y": 0.27 * i}) for i in range(12)] + [(1, 2, i, float(i), {"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}) for i in range(4)], f"plan_id long, stair long, seq long, at double, p {p}, q {p}")
    out = bim.stairs_steps(edges, _rows(spark, [(1, 2.4)], "plan_id long, height double"))
    return out.select("stair", F.col("steps").cast("long").alias("steps"), F.round("riser", 4).alias("riser"), F.size("treads").cast("long").alias("treads"))


# -- evaluation

_PRED = [(1, "door", 0.0, 0.0, 10.0, 10.0), (2, "door", 1.0, 0.0, 11.0, 10.0), (3, "window", 0.0, 0.0, 10.0, 10.0), (4, "window", 50.0, 50.0, 60.0, 60.0)]
_TRUE = [(1, "door", 0.0, 0.0, 10.0, 10.0), (2, "door", 5.0, 0.0, 15.0, 10.0), (3, "window", 0.0, 0.0, 20.0, 10.0), (4, "door", 90.0, 0.0, 99.0, 9.0)]


def _boxes(spark: SparkSession, rows: list) -> DataFrame:
    return _rows(spark, [(1, *r) for r in rows], "plan_id long, seq long, kind string, x0 double, y0 double, x1 double, y1 double")


def geo_match(spark: SparkSession, _: str) -> DataFrame:
    return evaluate.matches(_boxes(spark, _PRED), _boxes(spark, _TRUE)).select("kind", "seq", "truth_seq", F.round("iou", 4).alias("iou"))


def geo_scores(spark: SparkSession, _: str) -> DataFrame:
    a, b = _boxes(spark, _PRED), _boxes(spark, _TRUE)
    return evaluate.scores(a, b, evaluate.matches(a, b)).drop("mean_iou")


def geo_class_iou(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, [("wall", "wall", 80), ("wall", "bg", 20), ("bg", "wall", 20), ("bg", "bg", 880)], "truth string, predicted string, n long")
    return evaluate.class_iou(d).select("label", F.round("iou", 6).alias("iou"))


# -- raster kernels

_PICTURE = ["..........", ".########.", ".########.", ".########.", "..........", "...#......", "...#..###.", "...#......"]


def _mask(spark: SparkSession) -> DataFrame:
    data = bytes(int(c == "#") for row in _PICTURE for c in row)
    return _rows(spark, [(1, 10, 8, bytearray(data))], raster.MASKS)


def geo_components(spark: SparkSession, _: str) -> DataFrame:
    return raster.component_stats(raster.component_runs(_mask(spark))).select("label", "area", F.col("left").cast("long").alias("x0"), F.col("top").cast("long").alias("y0"), F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))


def geo_skeleton(spark: SparkSession, _: str) -> DataFrame:
    thin = raster.component_stats(raster.component_runs(raster.skeletons(_mask(spark)), diagonal=True))
    return thin.groupBy().agg(F.count("*").alias("parts"), F.max(F.col("bottom") - F.col("top")).cast("long").alias("tallest"))


def geo_wall_rects(spark: SparkSession, _: str) -> DataFrame:
    return raster.wall_rects(_mask(spark)).drop("plan_id")


def geo_merged_rects(spark: SparkSession, _: str) -> DataFrame:
    rects = _rows(spark, [(1, 1, 0.0, 0.0, 100.0, 10.0, "h"), (1, 2, 104.0, 0.0, 300.0, 10.0, "h"), (1, 3, 320.0, 0.0, 400.0, 10.0, "h"), (1, 4, 0.0, 50.0, 100.0, 60.0, "h"), (1, 5, 102.0, 40.0, 300.0, 70.0, "h")], RECTS)
    return raster.merged_rects(rects, 8.0).select("seq", "x0", "y0", "x1", "y1")


def geo_circle(spark: SparkSession, _: str) -> DataFrame:
    pts = [(1, 5 + 3 * x, 7 + 3 * y) for x, y in ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.6, 0.8))]
    out = raster.circles(_rows(spark, pts, "plan_id long, x double, y double"), ["plan_id"])
    return out.select("plan_id", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "r"))).withColumn("fits", F.lit(True))


def geo_simplify(spark: SparkSession, _: str) -> DataFrame:
    pts = [(0, 0.0, 0.0), (1, 5.0, 0.2), (2, 10.0, 0.0), (3, 10.0, 5.0), (4, 10.1, 8.0), (5, 10.0, 10.0)]
    return raster.simplified(_rows(spark, [(1, 1, i, x, y) for i, x, y in pts], "plan_id long, path long, i long, x double, y double"), 0.5).select("i", "x", "y")


_GREYS = [(1, 10, 50), (1, 12, 40), (1, 200, 300), (1, 210, 500), (2, 0, 10), (2, 100, 5), (2, 255, 10)]


def geo_otsu(spark: SparkSession, _: str) -> DataFrame:
    return raster.otsu(_rows(spark, _GREYS, "plan_id long, value int, n long"))


_RINGS = [(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]), (2, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), (3, [(1.0, 1.0), (7.5, 2.0), (5.0, 6.0), (0.5, 4.0)])]


def geo_ring_area(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, _RINGS, "i long, ring array<struct<x:double,y:double>>")
    return d.select("i", S.ring_area(F.col("ring")).alias("area"))


# -- sinks


def _entities(spark: SparkSession) -> DataFrame:
    none = (None, None, None)
    rows = [
        (1, 1, "line", "WALLS", [(0.0, 0.0), (10.0, 0.5)], *none, None, None, None, None, 0), (1, 2, "line", "WALLS", [(0.0, 5.0), (10.0, 5.0)], *none, None, None, None, None, 0),
        (1, 3, "circle", "SYMBOLS", [(5.0, 5.0)], 2.0, None, None, None, None, None, None, 0), (1, 4, "text", "TEXT", [(1.0, 9.0)], *none, None, None, "A < B", 7.2, 0),
        (1, 5, "arc", "DOORS", [(0.0, 0.0)], 10.0, 0.0, 90.0, None, None, None, None, 0), (1, 6, "polyline", "NEW", [(0.0, 0.0), (1.0, 1.0)], *none, True, None, None, None, 0),
    ]
    return _rows(spark, rows, drawing.ENTITIES)


def _drawing_plans(spark: SparkSession) -> DataFrame:
    return _rows(spark, [(1, 20.0, 10.0, 2.0)], "plan_id long, width double, height double, mm_per_px double")


def geo_svg(spark: SparkSession, _: str) -> DataFrame:
    return drawing.svg(_entities(spark), _drawing_plans(spark))


def geo_dxf(spark: SparkSession, _: str) -> DataFrame:
    return drawing.dxf(_entities(spark).where("seq in (1, 5)"), _drawing_plans(spark))


def geo_layout(spark: SparkSession, _: str) -> DataFrame:
    plans = _rows(spark, [(1, 3508.0, 2480.0, 8.466667), (2, 100.0, 300.0, None), (3, 1000.0, 500.0, 10.0)], "plan_id long, width double, height double, mm_per_px double")
    none = _rows(spark, [], drawing.ENTITIES)
    return drawing.layout(drawing.bounds(none, plans), plans).select("plan_id", "page_w", "scale", F.round("points_per_px", 6).alias("k"))


def _ifc(spark: SparkSession) -> DataFrame:
    rects, openings, plans = _model(spark)
    storeys = _rows(spark, [(1, 0, "UG", 2.5, -2.5, False), (1, 1, "EG", 2.8, 0.0, True)], "plan_id long, i int, name string, height double, elevation double, is_plan boolean")
    xy, box = "array<struct<x:double,y:double>>", [{"x": 0.3, "y": 0.3}, {"x": 4.0, "y": 0.3}, {"x": 4.0, "y": 3.0}, {"x": 0.3, "y": 3.0}]
    rooms = _rows(spark, [(1, 1, "Küche", 9.99, box), (1, 2, "Bad", 9.99, box)], f"plan_id long, label long, name string, area double, outline {xy}")
    slabs = _rows(spark, [(1, 1, box, 0.3, False)], f"plan_id long, seq long, outline {xy}, thickness double, lowest boolean")
    p = "struct<x:double,y:double>"
    edges = _rows(spark, [(1, 1, i, 0.27 * i, {"x": 0.0, "y": 0.27 * i}, {"x": 1.2, "y": 0.27 * i}) for i in range(12)], f"plan_id long, stair long, seq long, at double, p {p}, q {p}")
    stairs = bim.stairs_steps(edges, _rows(spark, [(1, 2.4)], "plan_id long, height double"))
    w, o = bim.wall_names(bim.walls(rects, plans)), bim.opening_names(bim.opening_details(openings, rects, plans))
    return ifc.ifc(w, o, storeys, 2.5, "2000-01-01T00:00:00", rooms, slabs, stairs)


def geo_ifc(spark: SparkSession, _: str) -> DataFrame:
    n = lambda kind: (F.size(F.split("ifc", f"={kind}\\(")) - 1).cast("long")
    kinds = ["WALL", "DOOR", "WINDOW", "BUILDINGSTOREY", "SPACE", "SLAB", "STAIR", "RELVOIDSELEMENT", "RELFILLSELEMENT", "ELEMENTQUANTITY", "PROPERTYSET"]
    defined, used = F.regexp_extract_all("ifc", F.lit(r"(?m)^#(\d+)="), 1), F.regexp_extract_all("ifc", F.lit(r"#(\d+)(?!\d*=)"), 1)
    loose = F.size(F.array_except(used, defined)).cast("long")
    return _ifc(spark).select("plan_id", *(n(f"IFC{k}").alias(f"n_{k.lower()}") for k in kinds), loose.alias("loose_references"), F.col("ifc").startswith("ISO-10303-21;").alias("framed"))


# -- openings, drawing content, angles

_BOXES = [(1, "door", 0.0, 0.0, 100.0, 10.0, "h"), (2, "window", 60.0, 0.0, 110.0, 10.0, "h"), (3, "window", 200.0, 0.0, 300.0, 10.0, "h"), (4, "door", 205.0, 0.0, 290.0, 10.0, "h"), (5, "window", 400.0, 0.0, 420.0, 10.0, "h"), (6, "window", 500.0, 0.0, 600.0, 40.0, "h")]


def _opening_rows(spark: SparkSession) -> DataFrame:
    return _rows(spark, [(1, *b) for b in _BOXES], OPENINGS)


def geo_distinct_openings(spark: SparkSession, _: str) -> DataFrame:
    return openings.distinct_openings(_opening_rows(spark)).select("seq")


def geo_plausible_openings(spark: SparkSession, _: str) -> DataFrame:
    return openings.plausible_openings(_opening_rows(spark), _rows(spark, [(1, 10.0)], "plan_id long, wall_px double")).select("seq", "plausible")


_PASSAGES = [(1, 1, "window", True), (1, 2, "window", False), (1, 3, "door", True), (2, 1, "window", True)]


def geo_passages(spark: SparkSession, _: str) -> DataFrame:
    rows = _rows(spark, _PASSAGES, "plan_id long, seq long, kind string, inside boolean")
    return openings.passages(rows).select("plan_id", "seq", "kind")


def geo_window_boxes(spark: SparkSession, _: str) -> DataFrame:
    xy = [(1, 0.0, 0.0, 50.0, 0.0), (2, 2.0, 30.0, 52.0, 30.0), (3, 1.0, 15.0, 51.0, 15.0), (4, 200.0, 0.0, 250.0, 0.0), (5, 300.0, 0.0, 300.0, 40.0), (6, 310.0, 0.0, 310.0, 41.0), (7, 0.0, 0.0, 5.0, 5.0)]
    return openings.window_boxes(_rows(spark, [(1, s, *p, "WINDOWS", 1.0, 1) for s, *p in xy], LINES), 20.0)


def geo_zones(spark: SparkSession, _: str) -> DataFrame:
    lines = _rows(spark, [(1, 1, 5.0, 5.0, 15.0, 5.0, "LINES", 1.0, 1), (1, 2, 5.0, 5.0, 25.0, 5.0, "LINES", 1.0, 1), (2, 3, 5.0, 5.0, 15.0, 5.0, "LINES", 1.0, 1)], LINES)
    return openings.in_zones(lines, _rows(spark, [(1, 0.0, 0.0, 20.0, 10.0)], "plan_id long, x0 double, y0 double, x1 double, y1 double")).select("plan_id", "seq")


_CHOICES = [("STAIRS", True, True, False, True, "STAIRS"), ("STAIRS", False, False, False, False, None), ("LINES", False, False, True, True, "WINDOWS"), ("DIMENSIONS", False, False, True, True, "DIMENSIONS"), ("DIMENSIONS", True, True, False, True, None), ("WALLS", True, True, False, False, "LINES"), ("WALLS", True, True, False, True, None), ("SYMBOLS", True, False, False, False, "SYMBOLS")]


def geo_line_choice(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, [(i, *c[:5]) for i, c in enumerate(_CHOICES)], "i long, layer string, inside boolean, deep boolean, well boolean, essential boolean")
    return d.select("i", openings.line_choice(*(F.col(c) for c in ("layer", "inside", "deep", "well", "essential"))).alias("choice"))


_KEPT = [("Küche", 90.0, "TEXT", True, True, True), ("ab", 90.0, "TEXT", True, True, False), ("12.5 m2", 20.0, "TEXT", True, True, True), ("M 1:100", 99.0, "TEXT", False, False, False), ("4.50", 90.0, "DIMENSIONS", False, False, True), ("4.50", 90.0, "DIMENSIONS", True, True, False), ("Wort", 50.0, "TEXT", True, True, False), ("7", 99.0, "TEXT", True, True, False)]


def geo_text_choice(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, [(i, *c[:5]) for i, c in enumerate(_KEPT)], "i long, text string, conf double, layer string, inside boolean, deep boolean")
    return d.select("i", openings.text_kept(*(F.col(c) for c in ("text", "conf", "layer", "inside", "deep"))).alias("kept"))


def geo_plan_title(spark: SparkSession, _: str) -> DataFrame:
    t = [(1, "Erdgeschoss", 200.0, 0.0, 90.0, False), (2, "Grundriss", 100.0, 1.0, 90.0, False), (3, "M 1:100", 300.0, 2.0, 90.0, False), (4, "leise", 400.0, 0.0, 50.0, False), (5, "Küche", 10.0, 0.0, 90.0, True), (6, "Plan", 10.0, 500.0, 90.0, False)]
    rows = _rows(spark, [(1, i, x, a, b, a + 50, b + 20, c, 0, n) for i, x, a, b, c, n in t], "plan_id long, seq long, text string, x0 double, y0 double, x1 double, y1 double, conf double, rotation int, inside boolean")
    return openings.plan_titles(rows)


def _segments(spark: SparkSession) -> DataFrame:
    import math

    rows = [(1, i, 0.0, 0.0, 100 * math.cos(math.radians(a)), 100 * math.sin(math.radians(a))) for i, a in enumerate([9.0, 9.1, 9.2, 99.1, 40.0])]
    return _rows(spark, rows, "plan_id long, seq long, x1 double, y1 double, x2 double, y2 double")


def geo_dominant_angle(spark: SparkSession, _: str) -> DataFrame:
    return openings.dominant_angle(_segments(spark)).select("plan_id", F.round("angle", 3).alias("angle"), F.round("clarity", 3).alias("clarity"))


def geo_skew(spark: SparkSession, _: str) -> DataFrame:
    return openings.skew(_segments(spark)).select("plan_id", F.round("angle", 3).alias("angle"))


_TRIED = [(1, 1.0, 0.80), (1, 0.7, 0.86), (1, 0.5, 0.87), (1, 0.35, 0.6), (2, 0.5, 0.4)]


def geo_chosen_scale(spark: SparkSession, _: str) -> DataFrame:
    return openings.chosen_scale(_rows(spark, _TRIED, "plan_id long, scale double, conf double"))


_AREAS = [(1, 1, 100), (1, 2, 5), (1, 3, 4), (2, 1, 3)]


def geo_large_components(spark: SparkSession, _: str) -> DataFrame:
    return openings.large_components(_rows(spark, _AREAS, "plan_id long, label long, area long")).select("plan_id", "label")


def geo_layer_counts(spark: SparkSession, _: str) -> DataFrame:
    return _entities(spark).groupBy("plan_id", "layer").agg(F.count("*").alias("n"))


def geo_bounds(spark: SparkSession, _: str) -> DataFrame:
    return drawing.bounds(_entities(spark), _drawing_plans(spark))


def geo_stamp_boxes(spark: SparkSession, _: str) -> DataFrame:
    texts = _rows(spark, [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 20.0, 10.0, 30.0), (1, 2, 100.0, 0.0, 110.0, 10.0), (1, None, 0.0, 0.0, 1.0, 1.0)], "plan_id long, grp long, x0 double, y0 double, x1 double, y1 double")
    frames = _rows(spark, [(1, 7, -5.0, -5.0, 15.0, 35.0), (1, 8, -9.0, -9.0, 19.0, 39.0)], "plan_id long, seq long, x0 double, y0 double, x1 double, y1 double")
    return drawing.stamp_boxes(texts, frames)


def geo_names(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, [(0, "/a/b/Plan EG (1).pdf"), (1, "???.png"), (2, "x" * 90), (3, 'a<b>&"c"')], "i long, t string")
    return d.select("i", S.safe_stem("t").alias("stem"), S.xml_escape("t").alias("xml"))


def geo_picture_source(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, [(0, "Canon", 300.0, False), (1, None, 300.0, False), (2, " ", 72.0, False), (3, None, None, True)], "i long, make string, dpi double, pdf boolean")
    s = readers.image_source(F.col("make"), F.col("dpi"), F.col("pdf"))
    return d.select("i", s["source"].alias("source"), s["dpi"].alias("dpi"))


def geo_points(spark: SparkSession, _: str) -> DataFrame:
    d = _rows(spark, [(0, 3.0, 4.0), (1, -2.0, 0.0), (2, 14.0, 1.0)], "i long, px double, py double")
    seg = S.point_segment_distance(F.col("px"), F.col("py"), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0))
    f = S.frame(F.lit(90.0), F.lit(3.0), F.lit(1.0), F.lit(3.0), F.lit(5.0))
    arc = S.arc_points(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(90.0))
    return d.select("i", F.round(seg, 4).alias("distance"), F.round(f["rho"], 4).alias("rho"), F.round(f["t1"], 4).alias("t1"), F.size(arc).cast("long").alias("arc_points"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("geo_")}

_CHAIN = [(s, "WALLS") for s in (1, 2, 3, 4, 5, 6)] + [(7, "DIMENSIONS"), (40, "DIMENSIONS"), (41, "DIMENSIONS"), (30, "DOORS"), (31, "LINES")] + [(s, "STAIRS") for s in range(10, 16)] + [(s, "HATCH") for s in range(21, 25)] + [(20, "LINES"), (25, "LINES")]

ORACLE_SQL = {
    "geo_ocr_lines": _sql("plan_id, rotation, text, x0, y0, x1, y1, conf", [(1, 0, "Grundriss EG", 50.0, 50.0, 152.5, 65.0, 90.5), (1, 0, "M 1:100", 50.0, 150.0, 112.5, 165.0, 90.5), (1, 0, "1:50", 300.0, 150.0, 345.0, 165.0, 95.0), (1, 0, "7", 150.0, 250.0, 160.0, 265.0, 85.0), (1, 90, "Grundriss", 50.0, 875.0, 65.0, 950.0, 91.0)]),
    "geo_scale": "select 1 as plan_id, 100 as ratio, round(25.4 / 300 * 100, 4) as mm_per_px, 'ratio' as source",
    "geo_dimparse": "with t as (" + _sql("i, text", list(enumerate(DIMENSION_TEXTS))) + r"""), u as (select i, text, rtrim(replace(trim(text), ' ', ''), '⁰¹²³⁴⁵⁶⁷⁸⁹') as t from t),
        v as (select i, text, case when regexp_full_match(t, '\d{1,3}') then cast(t as double) * 10 when regexp_full_match(t, '\d{1,3}[.,]\d{2}') then cast(replace(t, ',', '.') as double) * 1000 end as v from u)
        select i, case when v between 50 and 60000 then v end as mm, regexp_full_match(trim(text), '\d{1,3}([.,]\d{1,3})?[⁰¹²³⁴⁵⁶⁷⁸⁹]*') as numeric from v""",
    "geo_scale_texts": _sql("i, ratios, prefixed", [(0, "100", True), (1, "50", True), (2, "200", True), (3, "500", False), (4, "", False), (5, "", False), (6, "20", True)]),
    "geo_stamp_texts": _sql("i, line, area, marked, named, number", [(0, "02 Küche", None, False, True, "02"), (1, "F 12,5", 12.5, True, False, None), (2, "20.3 m²", 20.3, True, False, "20.3"), (3, "12.50", 12.5, False, False, "12.50"), (4, "Zimmer", None, False, False, None), (5, "Wohnen", None, False, True, None), (6, "02", None, False, False, "02"), (7, "BF=7.25", 7.25, True, False, None), (8, "3 m²", 3.0, True, False, "3"), (9, "W 1", None, False, False, None)]),
    "geo_area_fix": _sql("i, text, fixed", [(0, "235.5 m²", 25.5), (1, "20.3 m²", 20.0), (2, "12.35 m²", 12.3), (3, "117.0 m²", 17.0)]),
    "geo_consensus": "with r as (" + _sql("plan_id, v", _VALUES) + ") "
    """, c as (select plan_id, v, count(*) as w from r group by all), n as (select plan_id, count(*) as n from r group by all),
        m as (select a.plan_id, a.v, sum(b.w) as hits from c a join c b on a.plan_id = b.plan_id and abs(b.v - a.v) <= 0.06 * a.v group by a.plan_id, a.v qualify row_number() over (partition by a.plan_id order by hits desc, a.v) = 1),
        d as (select m.plan_id, m.hits, median(r.v) as med from m join r on r.plan_id = m.plan_id and abs(r.v - m.v) <= 0.06 * m.v group by all),
        s as (select *, row_number() over (partition by plan_id order by v) as i from r),
        p as (select a.plan_id, (a.v + b.v) / 2 as pair from s a join s b on a.plan_id = b.plan_id and a.i < b.i and b.v - a.v <= 0.025 * a.v join n on n.plan_id = a.plan_id and n.n between 2 and 4 qualify row_number() over (partition by a.plan_id order by a.i, b.i) = 1)
        select n.plan_id, n.n, round(case when n.n < 2 then null when d.hits >= 3 and d.hits >= 0.5 * n.n then d.med else p.pair end, 4) as value from n left join d on d.plan_id = n.plan_id left join p on p.plan_id = n.plan_id""",
    "geo_scale_ladder": "select 1 as plan_id, cast(5 as double) as mm_per_px, 'calibration' as source union all select 2, 8.1, 'chain' union all select 3, round(25.4 / 150 * 100, 6), 'ratio' union all select 4, 8.0, 'rooms' union all select 5, round(900 / 100.0, 6), 'doors' union all select 6, null, 'none'",
    "geo_pairs": "with r as (" + _sql("seq, x1, y1, x2, y2, w", _PLAN) + ") "
    """, g as (select seq, y1 = y2 as flat, case when y1 = y2 then y1 else x1 end as f, case when y1 = y2 then least(x1, x2) else least(y1, y2) end as a, case when y1 = y2 then greatest(x1, x2) else greatest(y1, y2) end as b from r where x1 = x2 or y1 = y2),
        h as (select * from g where b - a >= greatest(12 * 2, 0.025 * 1000))
        select 1 as plan_id, p.seq as seq_a, q.seq as seq_b from h p join h q on p.flat = q.flat and (q.f > p.f or (q.f = p.f and q.seq > p.seq)) and q.f - p.f between greatest(1.8 * 2, 0.003 * 1000) and 0.03 * 1000
        and least(p.b, q.b) - greatest(p.a, q.a) >= 0.4 * least(p.b - p.a, q.b - q.a)""",
    "geo_hatch": _sql("plan_id, seq", [(1, s) for s in range(21, 25)]),
    "geo_stairs": _sql("plan_id, seq", [(1, s) for s in range(10, 16)]),
    "geo_classify": _sql("kind, seq, layer, mm_per_px", [("line", s, layer, None) for s, layer in _CHAIN] + [("arc", 1, "DOORS", None), ("arc", 2, "LINES", None), ("text", 1, "DIMENSIONS", None), ("scale", 1, None, 10.0)]),
    "geo_bridges": _sql("seq", [(1,), (2,), (4,), (5,)]),
    "geo_room_names": _sql("plan_id, label, name", [(1, 1, "Kuche / Parkett"), (1, 2, "Wohnen / fern")]),
    "geo_stamps": _sql("plan_id, label, title, others, area, area_text, checked", [(1, 1, "01 Küche", "Parkett", 16.0, "16.0 m²", True), (1, 2, "Wohnen", "", 23.2, "23.2 m²", True)]),
    "geo_host": "with o as (" + _sql("seq, kind, x0, y0, x1, y1, orient", _OPENINGS) + "), r as (" + _sql("host, x0, y0, x1, y1, orient", _RECTS) + """), m as (
        select o.seq, host, (least(o.x1, r.x1) - greatest(o.x0, r.x0)) * (least(o.y1, r.y1) - greatest(o.y0, r.y0)) as area from o join r on o.orient = r.orient
        and least(o.x1, r.x1) > greatest(o.x0, r.x0) and least(o.y1, r.y1) > greatest(o.y0, r.y0)),
        b as (select * from m qualify row_number() over (partition by seq order by area desc, host) = 1)
        select 1 as plan_id, o.seq, b.host from o left join b on o.seq = b.seq""",
    "geo_walls": "with r as (" + _sql("seq, x0, y0, x1, y1, orient", _RECTS) + ") "
    """, m as (select seq, seq < 3 as external, case orient when 'h' then x1 - x0 else y1 - y0 end / 100 as length, case orient when 'h' then y1 - y0 else x1 - x0 end / 100 as thickness,
        case orient when 'h' then x0 else (x0 + x1) / 2 end / 100 as sx, (1000 - case orient when 'h' then (y0 + y1) / 2 else y0 end) / 100 as sy from r)
        select seq, case when external then 'Aussenwand ' else 'Innenwand ' end || lpad(cast(row_number() over (order by external desc, length desc, seq) as varchar), 2, '0') as name, external, round(length, 4) as length, round(thickness, 3) as thickness, round(sx, 4) as sx, round(sy, 4) as sy
        from m where length >= 0.1""",
    "geo_openings": _sql("seq, host, name, offset, width, height, sill".replace("offset", '"offset"'), [(1, 1, "Fenster 01", 1.2, 2.0, 1.2, 0.9), (2, 3, "Tür 01", 1.7, 0.9, 2.0, 0.0), (4, 1, "Fenster 02", 6.2, 0.7, 1.2, 0.9)]),
    "geo_summary": _sql("plan_id, walls, external, doors, windows, rooms, area", [(1, 4, 2, 1, 2, 3, 98.2)]),
    "geo_room_titles": "with r as (" + _sql("plan_id, label, name, top_px, left_px, area", _ROOMS) + ") "
    "select label, coalesce(name, 'Raum ' || lpad(cast(sum(cast(name is null as integer)) over (order by top_px, left_px, label) as varchar), 2, '0')) as name from r",
    "geo_model_json": _sql("plan_id, first_wall, width, second_space, n_walls", [(1, "Aussenwand 01", 2.0, "Küche", 4)]),
    "geo_wall_boxes": _sql("seq, kind, a, b, bottom, top", [(1, "solid", 0.0, 1.2, 0.0, 2.5), (1, "sill", 1.2, 3.2, 0.0, 0.9), (1, "lintel", 1.2, 3.2, 2.1, 2.5), (1, "solid", 3.2, 6.2, 0.0, 2.5), (1, "sill", 6.2, 6.9, 0.0, 0.9), (1, "lintel", 6.2, 6.9, 2.1, 2.5), (1, "solid", 6.9, 12.0, 0.0, 2.5), (2, "solid", 0.0, 8.0, 0.0, 2.5), (3, "solid", 0.0, 1.7, 0.0, 2.5), (3, "lintel", 1.7, 2.6, 2.0, 2.5), (3, "solid", 2.6, 7.7, 0.0, 2.5), (4, "solid", 0.0, 1.0, 0.0, 2.5)]),
    "geo_storeys": _sql("plan_id, i, name, height, elevation, is_plan", [(1, 0, "UG", 2.5, -2.5, False), (1, 1, "EG", 2.8, 0.0, True), (1, 2, "OG", 2.8, 2.8, False), (2, 0, "DG", 3.0, 0.0, True), (3, 0, "1OG", 2.7, 0.0, False), (3, 1, "DG", 2.4, 2.7, True)]),
    "geo_settings": _sql("plan_id, wall_height, sill_height, auto_thickness, storeys, plan_storey", [(1, 2.4, 0.9, True, "EG=3.1,OG=2.8", "auto"), (2, 2.5, 0.9, True, "EG=2.8", "auto"), (3, 2.5, 0.9, True, "EG=2.8", "auto"), (4, 2.7, 0.9, False, "OG=2.6", "OG")]),
    "geo_calibration": _sql("plan_id, mm_per_px", [(1, 10.0), (2, None), (3, None), (4, 4.0)]),
    "geo_stairs_steps": _sql("stair, steps, riser, treads", [(1, 12, 0.2, 11)]),
    "geo_match": _sql("kind, seq, truth_seq, iou", [("door", 1, 1, 1.0), ("door", 2, 2, 0.4286), ("window", 3, 3, 0.5)]),
    "geo_scores": _sql("kind, tp, fp, fn, precision, recall, f1", [("door", 2, 0, 1, 1.0, 0.666667, 0.8), ("window", 1, 1, 0, 0.5, 1.0, 0.666667)]),
    "geo_class_iou": _sql("label, iou", [("wall", 0.666667), ("bg", 0.956522)]),
    "geo_components": _sql("label, area, x0, y0, cx, cy", [(1, 24, 1, 1, 4.5, 2.0), (2, 3, 3, 5, 3.0, 6.0), (3, 3, 6, 6, 7.0, 6.0)]),
    "geo_wall_rects": _sql("seq, x0, y0, x1, y1, orient", [(0, 1.0, 1.0, 9.0, 4.0, "h"), (1, 3.0, 5.0, 4.0, 8.0, "v"), (2, 6.0, 6.0, 9.0, 7.0, "h")]),
    "geo_cleanup": _sql("seq, x1, y1, x2, y2", [(1, 0.0, 0.5, 204.0, 0.5), (3, 204.0, 0.5, 204.0, 150.0), (4, 0.0, 100.0, 204.0, 100.0), (7, 52.5, 0.5, 52.5, 100.0), (8, 60.0, 40.0, 90.0, 70.0)]),
    "geo_thick_walls": "with r as (" + _sql("seq, x1, y1, x2, y2, w", _THICK) + ") "
    "select seq from r where w >= 1.8 * 2 and sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) >= greatest(12 * 2, 0.025 * 1000) and (x1 = x2 or y1 = y2)",
    "geo_window_lines": _sql("seq", [(3,), (4,)]),
    "geo_skeleton": _sql("parts, tallest", [(3, 2)]),
    "geo_merged_rects": _sql("seq, x0, y0, x1, y1", [(1, 0.0, 0.0, 300.0, 10.0), (3, 320.0, 0.0, 400.0, 10.0), (4, 0.0, 50.0, 100.0, 60.0), (5, 102.0, 40.0, 300.0, 70.0)]),
    "geo_circle": _sql("plan_id, cx, cy, r, fits", [(1, 5.0, 7.0, 3.0, True)]),
    "geo_simplify": _sql("i, x, y", [(0, 0.0, 0.0), (2, 10.0, 0.0), (5, 10.0, 10.0)]),
    "geo_otsu": "with r as (" + _sql("plan_id, v, n", _GREYS) + ") "
    """, t as (select a.plan_id, a.v, sum(b.n) filter (b.v <= a.v) as w0, sum(b.n * b.v) filter (b.v <= a.v) as s0, sum(b.n) filter (b.v > a.v) as w1, sum(b.n * b.v) filter (b.v > a.v) as s1 from r a join r b on a.plan_id = b.plan_id group by a.plan_id, a.v)
        select plan_id, v as threshold from t where w1 > 0 qualify row_number() over (partition by plan_id order by round(w0 * w1 * (s0 / w0 - s1 / w1) ** 2, 6) desc, v) = 1""",
    "geo_ring_area": "with r as (" + _sql("i, k, n, x, y", [(i, k, len(p), *xy) for i, p in _RINGS for k, xy in enumerate(p)]) + ") "
    "select a.i, abs(sum(a.x * b.y - b.x * a.y)) / 2 as area from r a join r b on a.i = b.i and b.k = (a.k + 1) % a.n group by a.i",
    "geo_layout": _sql("plan_id, page_w, scale, k", [(1, 1190.55, 100, 0.24), (2, 841.89, None, 3.420469), (3, 1190.55, 50, 0.566929)]),
    "geo_ifc": _sql("plan_id, n_wall, n_door, n_window, n_buildingstorey, n_space, n_slab, n_stair, n_relvoidselement, n_relfillselement, n_elementquantity, n_propertyset, loose_references, framed", [(1, 4, 1, 2, 2, 2, 1, 1, 3, 3, 7, 8, 0, True)]),
    "geo_svg": _sql("plan_id, svg", [(1, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 20 10" preserveAspectRatio="xMidYMid meet" class="vec">' + drawing.STYLE + '<rect width="20" height="10" fill="#fff"/><g class="l-LINES"><path d="M0 0L1 1Z"/></g><g class="l-SYMBOLS"><circle cx="5" cy="5" r="2"/></g><g class="l-DOORS"><path d="M10 0A10 10 0 0 1 0 10"/></g><g class="l-WALLS"><path d="M0 0L10 0.5M0 5L10 5"/></g><g class="l-TEXT"><text x="1" y="9" font-size="10">A &lt; B</text></g></svg>')]),
    "geo_dxf": "select 1 as plan_id, " + "replace('" + "|".join(["0", "SECTION", "2", "HEADER", "9", "$ACADVER", "1", "AC1024", "9", "$INSUNITS", "70", "4", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES", "0", "LINE", "8", "WALLS", "10", "0.0000", "20", "20.0000", "11", "20.0000", "21", "19.0000", "0", "ARC", "8", "DOORS", "10", "0.0000", "20", "20.0000", "40", "20.0000", "50", "-90.0000", "51", "-0.0000", "0", "ENDSEC", "0", "EOF", ""]) + "', '|', chr(10)) as dxf",
    "geo_distinct_openings": _sql("seq", [(1,), (3,), (5,), (6,)]),
    "geo_plausible_openings": "with r as (" + _sql("seq, kind, x0, y0, x1, y1, orient", _BOXES) + ") "
    """, w as (select seq, case orient when 'h' then x1 - x0 else y1 - y0 end as w, case orient when 'h' then y1 - y0 else x1 - x0 end as d from r)
        select seq, w >= greatest(10, 0.42 * median(w) over ()) and d <= 22 as plausible from w""",
    "geo_passages": "with r as (" + _sql("plan_id, seq, kind, indoors", _PASSAGES) + ") "
    "select plan_id, seq, case when kind = 'window' and indoors and count(*) filter (kind = 'window' and not indoors) over (partition by plan_id) > 0 then 'door' else kind end as kind from r",
    "geo_window_boxes": _sql("plan_id, orient, x0, y0, x1, y1, n", [(1, "h", 0.0, 0.0, 52.0, 30.0, 3), (1, "v", 300.0, 0.0, 310.0, 41.0, 2)]),
    "geo_zones": _sql("plan_id, seq", [(1, 1)]),
    "geo_line_choice": _sql("i, choice", [(i, c[5]) for i, c in enumerate(_CHOICES)]),
    "geo_text_choice": _sql("i, kept", [(i, c[5]) for i, c in enumerate(_KEPT)]),
    "geo_plan_title": _sql("plan_id, title", [(1, "Grundriss Erdgeschoss")]),
    "geo_dominant_angle": _sql("plan_id, angle, clarity", [(1, 9.1, 0.8)]),
    "geo_skew": _sql("plan_id, angle", [(1, 9.1)]),
    "geo_chosen_scale": "with r as (" + _sql("plan_id, scale, conf", _TRIED) + ") "
    "select plan_id, max(scale) as scale from (select *, max(conf) over (partition by plan_id) as top from r) where conf >= top - 0.012 group by plan_id",
    "geo_large_components": "with r as (" + _sql("plan_id, label, area", _AREAS) + ") "
    "select plan_id, label from r qualify area >= 0.05 * max(area) over (partition by plan_id)",
    "geo_layer_counts": _sql("plan_id, layer, n", [(1, "WALLS", 2), (1, "SYMBOLS", 1), (1, "TEXT", 1), (1, "DOORS", 1), (1, "NEW", 1)]),
    "geo_bounds": _sql("plan_id, x0, y0, x1, y1", [(1, -10.0, -10.0, 10.0, 10.0)]),
    "geo_stamp_boxes": _sql("plan_id, grp, cx, cy, frame", [(1, 1, 5.0, 15.0, 7), (1, 2, 105.0, 5.0, None)]),
    "geo_names": _sql("i, stem, xml", [(0, "Plan EG _1", "/a/b/Plan EG (1).pdf"), (1, "plan", "???.png"), (2, "x" * 80, "x" * 90), (3, "a_b_c", "a&lt;b&gt;&amp;&quot;c&quot;")]),
    "geo_picture_source": _sql("i, source, dpi", [(0, "photo", None), (1, "scan", 300.0), (2, "image", None), (3, "pdf", None)]),
    "geo_points": _sql("i, distance, rho, t1, arc_points", [(0, 4.0, -3.0, 5.0, 31), (1, 2.0, -3.0, 5.0, 31), (2, 4.1231, -3.0, 5.0, 31)]),
}
