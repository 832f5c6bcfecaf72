"""A simple building model: walls, openings, storeys, names, stairs, as tables and one JSON a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeyline.functions import scalars as S
from storeyline.operators.helpers import best


def hosts(openings: DataFrame, rects: DataFrame) -> DataFrame:
    """(plan_id, seq, host): the wall rectangle of the same direction with the largest shared area; ties
    to the first; null where there is none. Cells of 512 px keep the join local."""
    cell = 512.0
    box = lambda: F.explode(F.flatten(F.transform(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)), lambda x: F.transform(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell)), lambda y: F.struct(x.alias("x"), y.alias("y"))))))
    a = openings.withColumn("cell", box())
    names = ["x0", "y0", "x1", "y1"]
    b = rects.withColumn("c", box()).select(F.col("plan_id").alias("p"), F.col("orient").alias("o"), "c", F.col("seq").alias("host"), *(F.col(n).alias(f"r_{n}") for n in names))
    area = S.box_overlap([F.col(n) for n in names], [F.col(f"r_{n}") for n in names])
    met = a.join(b, (F.col("plan_id") == F.col("p")) & (F.col("orient") == F.col("o")) & (F.col("cell") == F.col("c"))).withColumn("area", area).where("area > 0")
    found = best(met, ["plan_id", "seq"], [F.desc("area"), F.col("host")]).select("plan_id", "seq", "host")
    return openings.select("plan_id", "seq").join(found, ["plan_id", "seq"], "left")


def walls(rects: DataFrame, plans: DataFrame) -> DataFrame:
    """plan_id, seq, start, end (metres, y up), length, thickness, external of rectangles of 0.1 m or more.
    ``plans`` has mm_per_px, height and the settings; without a scale a plan has no walls."""
    r = rects.join(plans.where("mm_per_px > 0 and coalesce(scale_source, '') <> 'paper'"), "plan_id").withColumn("k", F.col("mm_per_px") / 1000)
    flat = F.col("orient") == "h"
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    m = lambda x, y: F.struct(F.bround(x * F.col("k"), 4).alias("x"), F.bround((F.col("height") - y) * F.col("k"), 4).alias("y"))
    start, end = F.when(flat, m(F.col("x0"), cy)).otherwise(m(cx, F.col("y0"))), F.when(flat, m(F.col("x1"), cy)).otherwise(m(cx, F.col("y1")))
    r = r.withColumns({"start": start, "end": end, "measured": F.when(flat, F.col("y1") - F.col("y0")).otherwise(F.col("x1") - F.col("x0")) * F.col("k")})
    r = r.withColumn("length", F.hypot(F.col("end.x") - F.col("start.x"), F.col("end.y") - F.col("start.y"))).where("length >= 0.1")
    thick = F.when(F.col("auto_thickness"), F.bround("measured", 3)).otherwise(F.col("default_thickness"))
    return r.select("plan_id", "seq", "orient", "x0", "y0", "x1", "y1", "k", "start", "end", "length", thick.alias("thickness"), F.when(F.col("auto_thickness"), "measured").otherwise("assumed").alias("thickness_source"), "external")


def opening_details(openings: DataFrame, rects: DataFrame, plans: DataFrame) -> DataFrame:
    """Hosted openings with kind, offset, width, height, sill in metres; those under 0.3 m are left out.
    ``plans`` has the settings and wall_height already bounded by the storey."""
    w = walls(rects, plans).select("plan_id", F.col("seq").alias("host"), F.col("orient").alias("w_orient"), F.when(F.col("orient") == "h", F.col("x0")).otherwise(F.col("y0")).alias("w0"), "k", "length")
    hosted = openings.join(hosts(openings, rects).where("host is not null"), ["plan_id", "seq"]).join(w, ["plan_id", "host"]).join(plans.select("plan_id", "wall_height", "door_height", "window_height", "sill_height"), "plan_id")
    a0, a1 = F.when(F.col("w_orient") == "h", F.col("x0")).otherwise(F.col("y0")), F.when(F.col("w_orient") == "h", F.col("x1")).otherwise(F.col("y1"))
    offset = F.greatest(F.lit(0.0), (a0 - F.col("w0")) * F.col("k"))
    hosted = hosted.withColumn("offset", offset).withColumn("o_width", F.least((a1 - a0) * F.col("k"), F.col("length") - F.col("offset"))).where("o_width >= 0.3")
    door = F.col("kind") == "door"
    sill = F.when(door, 0.0).otherwise(F.least("sill_height", F.greatest(F.lit(0.0), F.col("wall_height") - 0.3)))
    tall = F.when(door, F.least("door_height", "wall_height")).otherwise(F.least(F.col("window_height"), F.col("wall_height") - sill))
    return hosted.select("plan_id", "host", "seq", "kind", "offset", F.col("o_width").alias("width"), tall.alias("height"), sill.alias("sill"))


def _number(i: Column) -> Column:
    return F.when(i < 10, F.concat(F.lit("0"), i.cast("string"))).otherwise(i.cast("string"))


def wall_names(w: DataFrame) -> DataFrame:
    """Adds name: external walls first, longest first, numbered from 01 over the plan."""
    i = F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("external"), F.desc("length"), "seq"))
    return w.withColumn("name", F.concat(F.when(F.col("external"), "Aussenwand ").otherwise("Innenwand "), _number(i)))


def opening_names(o: DataFrame) -> DataFrame:
    """Adds name: doors and windows numbered apart, by wall then offset."""
    i = F.row_number().over(Window.partitionBy("plan_id", "kind").orderBy("host", "offset", "seq"))
    return o.withColumn("name", F.concat(F.when(F.col("kind") == "door", "Tür ").otherwise("Fenster "), _number(i)))


def room_titles(rooms: DataFrame) -> DataFrame:
    """Fills missing names with Raum 01, 02, ... from top to bottom, then left to right."""
    missing = F.col("name").isNull()
    i = F.sum(missing.cast("int")).over(Window.partitionBy("plan_id").orderBy("top", "left", "label").rowsBetween(Window.unboundedPreceding, 0))
    return rooms.withColumn("name", F.when(missing, F.concat(F.lit("Raum "), _number(i))).otherwise(F.col("name")))


def detected_storeys(texts: DataFrame) -> DataFrame:
    """(plan_id, detected): the storey of the best text; a title before others, then the first."""
    t = texts.withColumn("detected", S.storey_of("text")).where("detected is not null")
    return best(t, ["plan_id"], [F.desc(S.storey_score("text")), F.col("seq")]).select("plan_id", "detected")


def storeys(table: DataFrame, detected: DataFrame, wanted: DataFrame) -> DataFrame:
    """plan_id, i, name, height, elevation, is_plan. ``table`` has (plan_id, i, name, height), ``wanted``
    (plan_id, plan_storey). The plan's storey: the setting, the detected one (any case), a lone row
    renamed to the detected one, EG, the first. Elevations run up and down from EG, else the first."""
    t = table.join(detected, "plan_id", "left").join(wanted, "plan_id", "left")
    by = Window.partitionBy("plan_id")
    count = F.count("*").over(by)
    has = lambda c: F.max(F.when(c, F.col("i"))).over(by)
    first_of = lambda c: F.min(F.when(c, F.col("i"))).over(by)
    said = F.upper("name") == F.upper("detected")
    t = t.withColumns({"n": count, "by_setting": first_of((F.col("plan_storey") != "auto") & (F.col("name") == F.col("plan_storey"))), "by_text": first_of(said), "by_eg": first_of(F.col("name") == "EG"), "lowest": F.min("i").over(by)})
    renamed = F.col("by_setting").isNull() & F.col("by_text").isNull() & F.col("detected").isNotNull() & (F.col("n") == 1)
    t = t.withColumn("name", F.when(renamed, F.col("detected")).otherwise(F.col("name")))
    t = t.withColumn("plan_i", F.coalesce("by_setting", "by_text", "by_eg", "lowest"))
    t = t.withColumn("ref", F.coalesce(first_of(F.col("name") == "EG"), F.col("lowest")))
    below = F.coalesce(F.sum("height").over(by.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumn("below", below)
    zero = F.max(F.when(F.col("i") == F.col("ref"), F.col("below"))).over(by)
    return t.withColumn("elevation", F.bround(F.col("below") - zero, 3)).select("plan_id", "i", "name", "height", "elevation", (F.col("i") == F.col("plan_i")).alias("is_plan"))


def stairs_steps(edges: DataFrame, storey_height: DataFrame) -> DataFrame:
    """(plan_id, stair, steps, riser, treads): ordered edges and the quads between neighbours; needs five
    edges. ``edges`` has plan_id, stair, seq, at and the edge's ends p and q."""
    ordered = edges.groupBy("plan_id", "stair").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "p", "q"))).alias("e"))
    treads = F.zip_with(F.slice("e", F.lit(1), F.size("e") - 1), F.slice("e", F.lit(2), F.size("e") - 1), lambda a, b: F.array(a["p"], a["q"], b["q"], b["p"]))
    return ordered.where("size(e) >= 5").join(storey_height, "plan_id").select("plan_id", "stair", F.size("e").alias("steps"), (F.col("height") / F.size("e")).alias("riser"), treads.alias("treads"))


def summary(w: DataFrame, o: DataFrame, rooms: DataFrame) -> DataFrame:
    """(plan_id, walls, external, doors, windows, rooms, area): what the model holds."""
    a = w.groupBy("plan_id").agg(F.count("*").alias("walls"), F.count_if("external").alias("external"))
    b = o.groupBy("plan_id").agg(F.count_if(F.col("kind") == "door").alias("doors"), F.count_if(F.col("kind") == "window").alias("windows"))
    c = rooms.groupBy("plan_id").agg(F.count("*").alias("rooms"), F.round(F.sum("area"), 1).alias("area"))
    out = a.join(b, "plan_id", "full").join(c, "plan_id", "full")
    return out.select("plan_id", *(F.coalesce(F.col(n), F.lit(0)).alias(n) for n in ("walls", "external", "doors", "windows", "rooms")), F.coalesce("area", F.lit(0.0)).alias("area"))


def model_json(w: DataFrame, o: DataFrame, rooms: DataFrame, elevation: DataFrame) -> DataFrame:
    """(plan_id, json): walls in order with their openings, and rooms; lengths to 4 digits, areas to 1."""
    r = lambda c: F.bround(F.col(c), 4).alias(c)
    inner = o.groupBy("plan_id", F.col("host").alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "seq", "kind", "name", "width", "height", "sill"))), lambda s: F.struct(s["kind"].alias("kind"), s["name"].alias("name"), F.bround(s["offset"], 4).alias("offset"), F.bround(s["width"], 4).alias("width"), F.bround(s["height"], 4).alias("height"), F.bround(s["sill"], 4).alias("sill"))).alias("openings"))
    full = w.join(inner, ["plan_id", "seq"], "left").groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name", "external", "start", "end", "thickness", "openings"))), lambda s: F.struct(s["name"].alias("name"), s["external"].alias("external"), F.array(s["start"]["x"], s["start"]["y"]).alias("start"), F.array(s["end"]["x"], s["end"]["y"]).alias("end"), s["thickness"].alias("thickness"), F.coalesce(s["openings"], F.array()).alias("openings"))).alias("walls"))
    spaces = rooms.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("top", "left", "name", "area"))), lambda s: F.struct(s["name"].alias("name"), F.bround(s["area"], 1).alias("area"))).alias("spaces"))
    out = full.join(spaces, "plan_id", "left").join(elevation, "plan_id", "left")
    return out.select("plan_id", F.to_json(F.struct("elevation", "walls", F.coalesce("spaces", F.array()).alias("spaces"))).alias("json"))


def wall_boxes(w: DataFrame, o: DataFrame, wall_height: float) -> DataFrame:
    """(plan_id, seq, kind, a, b, bottom, top): each wall cut at its openings into solid pieces, the sill
    below and the lintel above each opening. A running maximum of ends lets openings overlap."""
    by = Window.partitionBy("plan_id", "host").orderBy("offset", "seq")
    cut = o.withColumn("end", F.col("offset") + F.col("width"))
    cut = cut.withColumn("before", F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    part = lambda kind, a, b, low, high: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), low.alias("bottom"), high.alias("top"))
    top, zero = F.lit(wall_height), F.lit(0.0)
    start = F.greatest("offset", "before")
    pieces = cut.select("plan_id", F.col("host").alias("seq"), F.inline(F.array(part("solid", F.col("before"), F.col("offset"), zero, top), part("sill", start, F.col("end"), zero, F.col("sill")), part("lintel", start, F.col("end"), F.col("sill") + F.col("height"), top))))
    ends = cut.groupBy("plan_id", F.col("host").alias("seq")).agg(F.max("end").alias("a"))
    rest = w.join(ends, ["plan_id", "seq"], "left").select("plan_id", "seq", F.lit("solid").alias("kind"), F.coalesce("a", F.lit(0.0)).alias("a"), F.col("length").alias("b"), zero.alias("bottom"), top.alias("top"))
    return pieces.unionByName(rest).where("b - a > 1e-6 and top - bottom > 1e-6")
