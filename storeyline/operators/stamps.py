"""Rooms and their stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storeyline.functions import scalars as S
from storeyline.operators.helpers import best, islands


def room_of_text(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """(plan_id, seq, label): the room whose row of pixels holds the text's centre (run-length rows)."""
    cx, cy = F.floor((F.col("x0") + F.col("x1")) / 2), F.floor((F.col("y0") + F.col("y1")) / 2)
    t = texts.select("plan_id", "seq", cx.alias("cx"), cy.cast("int").alias("y"))
    return t.join(runs, ["plan_id", "y"]).where("cx between xa and xb").select("plan_id", "seq", "label")


def room_names(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """(plan_id, label, name): the distinct texts of a room, in their order."""
    words = texts.where(F.col("text").rlike("[A-Za-zÄÖÜäöü]") & ~F.col("text").rlike(r"(?iu)^\s*[\d.,\s]+(m2|m²|m)?\s*$"))
    met = words.join(room_of_text(words, runs), ["plan_id", "seq"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("t")))), lambda s: s["t"])
    return met.groupBy("plan_id", "label").agg(F.array_join(F.array_distinct(listed), " / ").alias("name"))


def stamp_lines(texts: DataFrame) -> DataFrame:
    """kind ('area', 'text', 'nr') and value of the texts that belong into a stamp."""
    t = texts.withColumns({"line": S.stamp_line("text"), "area": S.area_m2("text"), "marked": S.has_area_mark("text")})
    number = S.number_prefix("line")
    is_area = F.col("area").isNotNull() & (F.col("marked") | (F.col("conf") >= 80))
    is_nr = number["number"].isNotNull() & (F.col("conf") >= 75) & ((number["rest"] == "") | number["rest"].rlike("[A-Za-zÄÖÜäöü]"))
    t = t.withColumn("kind", F.when(is_area, "area").when(S.is_name("text", "conf"), "text").when(is_nr, "nr"))
    return t.where("kind is not null").withColumn("value", F.when(F.col("kind") == "nr", number["number"]).otherwise(F.col("line")))


def stamps(texts: DataFrame, rooms: DataFrame) -> DataFrame:
    """(plan_id, label, title, others, area, area_text, checked): each room's stamp. ``texts`` has label,
    ``rooms`` has plan_id, label, area_px, mm_per_px. The title is the first line, a number with the
    text that follows it; other lines ("Parkett") stay apart.

    Lines within 2.5 heights below one another and 6 beside form a block; the block of most lines,
    then of most confidence, is the stamp. An area off the measured one by more than 8 % is put
    right where dropping a digit fits, else flagged (checked = false)."""
    by = ["plan_id", "label"]
    t = stamp_lines(texts).withColumn("mid", (F.col("y0") + F.col("y1")) / 2)
    heights = texts.where("y1 > y0").groupBy(*by).agg(F.median(F.col("y1") - F.col("y0")).alias("th"))
    t = t.join(heights, by)
    w = Window.partitionBy(*by).orderBy("mid", "seq")
    apart = (F.col("y0") - F.lag("y1").over(w) > 2.5 * F.col("th")) | (F.abs((F.col("x0") + F.col("x1")) / 2 - F.lag((F.col("x0") + F.col("x1")) / 2).over(w)) >= 6 * F.col("th"))
    t = islands(t, by, ["mid", "seq"], F.coalesce(apart, F.lit(True)), "block")
    blocks = t.groupBy(*by, "block").agg(F.count("*").alias("n"), F.sum("conf").alias("sure"), F.array_sort(F.collect_list(F.struct("mid", "seq", "kind", "value", "area"))).alias("lines"))
    block = best(blocks, by, [F.desc("n"), F.desc("sure"), F.col("block")]).where((F.col("n") > 1) | (F.col("lines")[0]["kind"] != "nr"))
    block = block.join(rooms, by).withColumn("measured", F.col("area_px") * F.col("mm_per_px") * F.col("mm_per_px") / 1e6)
    said = F.filter("lines", lambda s: s["kind"] != "area")
    # a text right after a number, in the order of all lines, is on the number's line
    joins = lambda i: (i > 0) & (F.col("lines")[i]["kind"] == "text") & (F.try_element_at("lines", i)["kind"] == "nr")
    merged = F.filter(
        F.transform("lines", lambda s, i: F.when((s["kind"] == "area") | F.coalesce(joins(i), F.lit(False)), None).when((s["kind"] == "nr") & (F.try_element_at("lines", i + 2)["kind"] == "text"), F.concat_ws(" ", s["value"], F.try_element_at("lines", i + 2)["value"])).otherwise(s["value"])),
        lambda x: x.isNotNull(),
    )
    block = block.withColumn("named", merged)
    block = block.withColumns({"title": F.when(F.size(said) > 0, F.col("named")[0]).otherwise(F.lit("")), "others": F.array_join(F.slice("named", 2, 100), "; "), "read": F.try_element_at(F.transform(F.filter("lines", lambda s: s["kind"] == "area"), lambda s: s["area"]), F.lit(1))})
    off = F.abs(F.col("read") - F.col("measured")) > 0.08 * F.col("measured")
    block = block.withColumn("area", F.when(off, F.coalesce(S.digit_drops(F.col("read"), F.col("measured")), F.col("read"))).otherwise(F.col("read")))
    fits = F.abs(F.col("area") - F.col("measured")) <= 0.08 * F.col("measured")
    return block.select(*by, "title", "others", "area", S.area_text("area").alias("area_text"), F.coalesce(fits, F.lit(True)).alias("checked"))
