"""What a caller gets: result and error envelopes as JSON, models as OBJ text, the title block's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = ("prepare", "recognise", "draw", "write", "model")


def envelopes(plans: DataFrame) -> DataFrame:
    """(plan_id, json): ``plans`` has svg, warnings, layers (map), scale_note, unit, width, height, summary (a struct or
    null), model_error and error. An error of the plan leaves an error envelope; one of the model only
    makes the model unavailable, the drawing is delivered."""
    model = F.when(F.col("model_error").isNull() & F.col("summary").isNotNull(), F.to_json(F.struct(F.lit(True).alias("available"), "summary"))).otherwise(F.to_json(F.struct(F.lit(False).alias("available"), F.coalesce("model_error", F.lit("no walls")).alias("reason"))))
    whole = F.to_json(F.struct(F.lit(True).alias("ok"), "svg", F.array_distinct(F.coalesce("warnings", F.array().cast("array<string>"))).alias("warnings"), "layers", "scale_note", "unit", F.array("width", "height").alias("size")))
    ok = F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit(',"bim":'), model, F.lit("}"))
    wrong = F.to_json(F.struct(F.lit(False).alias("ok"), F.lit("The plan could not be read.").alias("message"), F.col("error").alias("detail")))
    return plans.select("plan_id", F.when(F.col("error").isNotNull(), wrong).otherwise(ok).alias("json"))


def loaded(files: DataFrame, most: int = 1800) -> DataFrame:
    """(plan_id, json): size, pages and the preview's size of pictures that were read, or why not."""
    k = F.least(F.lit(1.0), most / F.greatest("width", "height"))
    side = lambda c: F.floor(F.col(c) * k).cast("int")
    good = F.to_json(F.struct(F.lit(True).alias("ok"), "width", "height", "pages", F.array(side("width"), side("height")).alias("preview")))
    return files.select("plan_id", F.when(F.col("error").isNull(), good).otherwise(F.to_json(F.struct(F.lit(False).alias("ok"), F.col("error").alias("detail")))).alias("json"))


def obj(walls: DataFrame, pieces: DataFrame) -> DataFrame:
    """(plan_id, obj): the pieces of ``bim.wall_boxes`` as boxes of eight corners and six faces; corners are counted
    on through the plan, as the format wants it."""
    size = F.hypot(F.col("end.x") - F.col("start.x"), F.col("end.y") - F.col("start.y"))
    w = walls.select("plan_id", "seq", "start", "thickness", ((F.col("end.x") - F.col("start.x")) / size).alias("ux"), ((F.col("end.y") - F.col("start.y")) / size).alias("uy"))
    p = pieces.join(w, ["plan_id", "seq"])
    n = F.row_number().over(Window.partitionBy("plan_id").orderBy("seq", "a", "bottom", "b", "top")) - 1
    number = lambda c: F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", "")

    def corner(along: str, side: float, up: str) -> Column:
        x = F.col("start.x") + F.col("ux") * F.col(along) - F.col("uy") * F.col("thickness") * side
        y = F.col("start.y") + F.col("uy") * F.col(along) + F.col("ux") * F.col("thickness") * side
        return F.concat_ws(" ", F.lit("v"), number(x), number(F.col(up)), number(-y))

    corners = [corner(a, s, u) for u in ("bottom", "top") for a, s in (("a", -0.5), ("b", -0.5), ("b", 0.5), ("a", 0.5))]
    faces = ((1, 2, 3, 4), (5, 8, 7, 6), (1, 5, 6, 2), (2, 6, 7, 3), (3, 7, 8, 4), (4, 8, 5, 1))
    face = [F.concat_ws(" ", F.lit("f"), *((F.col("n") * 8 + k).cast("string") for k in f)) for f in faces]
    name = F.concat(F.lit("o "), F.col("kind"), F.lit("_"), F.col("seq").cast("string"), F.lit("_"), F.col("n").cast("string"))
    lines = p.withColumn("n", n).select("plan_id", "n", F.concat_ws("\n", name, *corners, *face).alias("text"))
    return lines.groupBy("plan_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]), "\n"), F.lit("\n")).alias("obj"))


def title_block(plans: DataFrame) -> DataFrame:
    """(plan_id, lines): what the title block says, cut to its width. ``plans`` has title, plan_title, scale,
    scale_note and date."""
    scale = F.when(F.col("scale") > 0, F.concat(F.lit("Massstab 1:"), F.col("scale").cast("string"), F.lit(" (A3)"))).otherwise("unmassstäblich")
    lines = [F.substring(F.coalesce("plan_title", "title"), 1, 60), scale, F.concat(F.lit("Datum "), F.date_format("date", "dd.MM.yyyy")), F.substring(F.coalesce("scale_note", F.lit("")), 1, 70)]
    return plans.select("plan_id", F.array(*lines).alias("lines"))


def scale_bar(scale: Column, step_m: Column, x: Column, mm: float = 72 / 25.4) -> Column:
    """Five segments [(from, to, filled)] of ``step_m`` metres at 1:scale, in points."""
    step = step_m * 1000 / scale * mm
    return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((x + i * step).alias("a"), (x + (i + 1) * step).alias("b"), (i % 2 == 0).alias("filled")))
