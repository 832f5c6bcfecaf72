"""Drawings as SVG and DXF text, and where they go on a page.

Every entity becomes a fragment by a column expression; fragments are put in order and joined by
one aggregation a plan. Entities are one table: plan_id, seq, type (line, arc, circle, polyline,
hatch, text), layer, points array<struct<x,y>>, r, start, end, closed, rings, text, size, rotation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storeyline.functions.scalars import xml_escape
from storeyline.operators.helpers import best, cells

ENTITIES = "plan_id long, seq long, type string, layer string, points array<struct<x:double,y:double>>, r double, start double, end double, closed boolean, rings array<array<struct<x:double,y:double>>>, text string, size double, rotation int"
# Drawing order of the layers, page and scales.
ORDER = ("HATCH", "LINES", "SYMBOLS", "STAIRS", "DIMENSIONS", "WINDOWS", "DOORS", "WALLS", "TEXT", "ROOMS")
PAGE_LONG, PAGE_SHORT, MM = 1190.55, 841.89, 72 / 25.4
MARGIN, HEAD, GAP = 15 * MM, 24 * MM, 4 * MM
SCALES = (20, 50, 100, 200, 500, 1000)
# Stroke widths by layer; all strokes keep their width when the drawing is scaled.
WIDTHS = {"WALLS": 1.8, "DIMENSIONS": 0.8, "HATCH": 0.6, "WINDOWS": 0.8, "DOORS": 0.8}
STYLE = (
    "<style>.vec path,.vec circle{fill:none;stroke:#111;stroke-width:1;stroke-linecap:round;stroke-linejoin:round;vector-effect:non-scaling-stroke}"
    + "".join(f".vec .l-{k} path{{stroke-width:{v}}}" for k, v in WIDTHS.items())
    + ".vec path.fill{fill:#9a9a9a;stroke:none;fill-rule:evenodd}.vec text{font-family:Helvetica,Arial,sans-serif;fill:#111}</style>"
)


def short_number(c: Column) -> Column:
    """One decimal, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.1f", c), r"\.0$", "")


def _at(p: Column) -> Column:
    return F.concat(short_number(p["x"]), F.lit(" "), short_number(p["y"]))


def _path(points: Column, closed: Column) -> Column:
    return F.concat(F.lit("M"), F.array_join(F.transform(points, _at), "L"), F.when(closed, "Z").otherwise(""))


def svg_fragments(entities: DataFrame) -> DataFrame:
    """Adds layer (unknown ones as LINES), ord, is_path and frag."""
    e = entities.withColumn("layer", F.when(F.col("layer").isin(*ORDER), F.col("layer")).otherwise("LINES"))
    c, n = F.col("points")[0], short_number
    on = lambda a: F.struct((c["x"] + F.col("r") * F.cos(F.radians(a))).alias("x"), (c["y"] + F.col("r") * F.sin(F.radians(a))).alias("y"))
    arc = F.concat(F.lit("M"), _at(on("start")), F.lit("A"), n(F.col("r")), F.lit(" "), n(F.col("r")), F.when(F.col("end") - F.col("start") > 180, " 0 1 1 ").otherwise(" 0 0 1 "), _at(on("end")))
    circle = F.concat(F.lit('<circle cx="'), n(c["x"]), F.lit('" cy="'), n(c["y"]), F.lit('" r="'), n(F.col("r")), F.lit('"/>'))
    turn = F.when(F.col("rotation") == 90, F.concat(F.lit(' transform="rotate(-90 '), _at(c), F.lit(')"'))).otherwise("")
    text = F.concat(F.lit('<text x="'), n(c["x"]), F.lit('" y="'), n(c["y"]), F.lit('" font-size="'), n(F.greatest(F.lit(4.0), F.col("size") / 0.72)), F.lit('"'), turn, F.lit(">"), xml_escape("text"), F.lit("</text>"))
    rings = F.array_join(F.transform("rings", lambda r: _path(r, F.lit(True))), "")
    kind = F.col("type")
    frag = F.when(kind.isin("line", "polyline"), _path(F.col("points"), F.coalesce("closed", F.lit(False)))).when(kind == "arc", arc).when(kind == "circle", circle).when(kind == "hatch", rings).when(kind == "text", text)
    order = F.array_position(F.array(*map(F.lit, ORDER)), F.col("layer"))
    return e.withColumns({"frag": frag, "ord": F.when(kind == "hatch", 0).otherwise(order), "is_path": ~kind.isin("circle", "text")})


def svg(entities: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, svg): filled areas first, then the layers in drawing order, paths before the rest."""
    f = svg_fragments(entities)
    layers = f.groupBy("plan_id", "ord", F.when(F.col("ord") == 0, "HATCH").otherwise(F.col("layer")).alias("layer")).agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(w, F.struct("seq", "frag")))), lambda s: s["frag"]), "").alias(n) for n, w in (("paths", F.col("is_path")), ("others", ~F.col("is_path")))))
    fill = F.when(F.col("ord") == 0, ' class="fill"').otherwise("")
    drawn = F.concat(F.lit('<g class="l-'), F.col("layer"), F.lit('">'), F.when(F.col("paths") != "", F.concat(F.lit("<path"), fill, F.lit(' d="'), F.col("paths"), F.lit('"/>'))).otherwise(""), F.col("others"), F.lit("</g>"))
    whole = layers.withColumn("g", drawn).groupBy("plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "g"))), lambda s: s["g"]), "").alias("body"))
    out = plans.select("plan_id", "width", "height").join(whole, "plan_id", "left")
    size = F.concat(short_number(F.col("width")), F.lit(" "), short_number(F.col("height")))
    ground = F.concat(F.lit('<rect width="'), short_number(F.col("width")), F.lit('" height="'), short_number(F.col("height")), F.lit('" fill="#fff"/>'))
    return out.select("plan_id", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), size, F.lit('" preserveAspectRatio="xMidYMid meet" class="vec">'), F.lit(STYLE), ground, F.coalesce("body", F.lit("")), F.lit("</svg>")).alias("svg"))


def dxf(entities: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, dxf): entities in model space, y up, millimetres where the scale is known (pixels
    otherwise); arcs turn the other way round. ``plans`` has height and mm_per_px."""
    e = entities.join(plans.select("plan_id", "height", F.coalesce("mm_per_px", F.lit(1.0)).alias("f")), "plan_id")
    num = lambda c: F.format_string("%.4f", c)
    pair = lambda code, c: F.concat(F.lit(f"{code}\n"), c, F.lit("\n"))
    x = lambda p: num(p["x"] * F.col("f"))
    y = lambda p: num((F.col("height") - p["y"]) * F.col("f"))
    head = lambda kind: F.concat(pair(0, F.lit(kind)), pair(8, F.col("layer")))
    p, q, r = F.col("points")[0], F.col("points")[1], num(F.col("r") * F.col("f"))
    vertices = lambda points: F.array_join(F.transform(points, lambda v: F.concat(pair(10, x(v)), pair(20, y(v)))), "")
    poly = lambda points, closed: F.concat(head("LWPOLYLINE"), pair(90, F.size(points).cast("string")), pair(70, F.when(closed, "1").otherwise("0")), vertices(points))
    kind = F.col("type")
    frag = (
        F.when(kind == "line", F.concat(head("LINE"), pair(10, x(p)), pair(20, y(p)), pair(11, x(q)), pair(21, y(q))))
        .when(kind == "arc", F.concat(head("ARC"), pair(10, x(p)), pair(20, y(p)), pair(40, r), pair(50, num(-F.col("end"))), pair(51, num(-F.col("start")))))
        .when(kind == "circle", F.concat(head("CIRCLE"), pair(10, x(p)), pair(20, y(p)), pair(40, r)))
        .when(kind == "polyline", poly(F.col("points"), F.coalesce("closed", F.lit(False))))
        .when(kind == "hatch", F.array_join(F.transform("rings", lambda v: poly(v, F.lit(True))), ""))
        .when(kind == "text", F.concat(head("TEXT"), pair(10, x(p)), pair(20, y(p)), pair(40, num(F.greatest(F.col("size") * F.col("f"), F.lit(1e-3)))), pair(50, F.col("rotation").cast("string")), pair(1, F.regexp_replace("text", r"[\r\n]+", " "))))
    )
    body = e.withColumn("frag", frag).groupBy("plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frag"))), lambda s: s["frag"]), "").alias("body"))
    out = plans.join(body, "plan_id", "left")
    unit = F.when(F.col("mm_per_px").isNotNull(), "4").otherwise("0")
    start = F.concat(F.lit("0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1024\n9\n$INSUNITS\n70\n"), unit, F.lit("\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n"))
    return out.select("plan_id", F.concat(start, F.coalesce("body", F.lit("")), F.lit("0\nENDSEC\n0\nEOF\n")).alias("dxf"))


def bounds(entities: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, x0, y0, x1, y1) of all entities, circles and arcs as whole circles; the picture if empty."""
    round_ = F.col("type").isin("arc", "circle")
    c = F.col("points")[0]
    box = F.array(F.struct((c["x"] - F.col("r")).alias("x"), (c["y"] - F.col("r")).alias("y")), F.struct((c["x"] + F.col("r")).alias("x"), (c["y"] + F.col("r")).alias("y")))
    pts = F.when(round_, box).when(F.col("type") == "hatch", F.flatten("rings")).otherwise(F.col("points"))
    b = entities.select("plan_id", F.explode(pts).alias("p")).groupBy("plan_id").agg(F.min("p.x").alias("x0"), F.min("p.y").alias("y0"), F.max("p.x").alias("x1"), F.max("p.y").alias("y1"))
    return plans.select("plan_id", "width", "height").join(b, "plan_id", "left").select("plan_id", F.coalesce("x0", F.lit(0.0)).alias("x0"), F.coalesce("y0", F.lit(0.0)).alias("y0"), F.coalesce("x1", "width").alias("x1"), F.coalesce("y1", "height").alias("y1"))


def layout(boxes: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, page_w, page_h, points_per_px, scale): the largest of the common scales that fits the
    page lying or standing; without one, or without a scale of the plan, the page is filled (scale null)."""
    b = boxes.join(plans.select("plan_id", "mm_per_px"), "plan_id").withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})
    lying = F.col("w") >= F.col("h")
    b = b.withColumns({"page_w": F.when(lying, PAGE_LONG).otherwise(PAGE_SHORT), "page_h": F.when(lying, PAGE_SHORT).otherwise(PAGE_LONG)})
    b = b.withColumns({"free_w": F.col("page_w") - 2 * MARGIN, "free_h": F.col("page_h") - 2 * MARGIN - HEAD - GAP})
    fits = F.filter(F.array(*map(F.lit, SCALES)), lambda n: (F.col("w") * F.col("mm_per_px") / n * MM <= F.col("free_w")) & (F.col("h") * F.col("mm_per_px") / n * MM <= F.col("free_h")))
    b = b.withColumn("scale", F.array_min(F.when(F.col("mm_per_px").isNotNull(), fits)))
    filled = F.least(F.col("free_w") / F.greatest("w", F.lit(1.0)), F.col("free_h") / F.greatest("h", F.lit(1.0)))
    return b.select("plan_id", "page_w", "page_h", F.when(F.col("scale").isNotNull(), F.col("mm_per_px") / F.col("scale") * MM).otherwise(filled).alias("points_per_px"), "scale")


def stamp_boxes(texts: DataFrame, frames: DataFrame) -> DataFrame:
    """(plan_id, grp, cx, cy, frame): groups' mean centres and the first frame around each, if any."""
    g = texts.where("grp is not null").groupBy("plan_id", "grp").agg(F.avg((F.col("x0") + F.col("x1")) / 2).alias("cx"), F.avg((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    size, box = 512.0, ("x0", "y0", "x1", "y1")
    f = frames.select(F.col("plan_id").alias("p"), F.col("seq").alias("frame"), *(F.col(c).alias(f"f_{c}") for c in box), F.explode(cells(*map(F.col, box), size)).alias("f_cell"))
    own = F.struct(F.floor(F.col("cx") / size).alias("x"), F.floor(F.col("cy") / size).alias("y"))
    met = g.join(f, (F.col("plan_id") == F.col("p")) & (own == F.col("f_cell")) & F.col("cx").between(F.col("f_x0"), F.col("f_x1")) & F.col("cy").between(F.col("f_y0"), F.col("f_y1")), "left")
    return best(met, ["plan_id", "grp"], [F.col("frame").asc_nulls_last()]).select("plan_id", "grp", "cx", "cy", "frame")
