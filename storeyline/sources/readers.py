"""Sources: plan files, OCR tables, settings, calibration and training metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeyline.functions.scalars import homography

EXTENSIONS = ("jpg", "jpeg", "png", "webp", "tif", "tiff", "bmp", "pdf")
MAX_BYTES = 80 << 20


def plan_files(spark: SparkSession, path: str) -> DataFrame:
    """path, extension, length, content and error: files that are no plans keep a row with the reason
    (Spark passes over empty files)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    df = df.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)))
    reason = F.when(~F.col("extension").isin(*EXTENSIONS), F.concat(F.lit("unsupported file type: "), F.col("extension"))).when(F.col("length") > MAX_BYTES, F.lit("file is larger than 80 MB"))
    return df.select("path", "extension", "length", F.when(reason.isNull(), F.col("content")).alias("content"), reason.alias("error"))


def image_source(make: Column, dpi: Column, is_pdf: Column) -> Column:
    """struct(source, dpi): a camera's make marks a photo, whose resolution says nothing; elsewhere
    150 to 1200 dpi are believed and mark a scan."""
    photo = F.coalesce(F.trim(make) != "", F.lit(False))
    trusted = F.when(~photo & dpi.between(150, 1200), dpi)
    return F.struct(F.when(is_pdf, "pdf").when(photo, "photo").when(trusted.isNotNull(), "scan").otherwise("image").alias("source"), F.when(is_pdf, dpi).otherwise(trusted).alias("dpi"))


def ocr_words(tables: DataFrame) -> DataFrame:
    """OCR_WORDS from (plan_id, rotation, tsv). A row needs 11 fields, digits in the first and
    numbers in the next; quotes are data, so this is no CSV."""
    rows = tables.select("plan_id", "rotation", F.posexplode(F.split("tsv", r"\r\n|\n|\r")).alias("seq", "line")).withColumn("p", F.split("line", "\t"))
    rows = rows.where((F.size("p") >= 11) & F.trim(F.col("p")[0]).rlike(r"^\d+$"))
    names = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height"]
    whole = lambda c: F.trim(c).try_cast("double").try_cast("int")
    rows = rows.select("plan_id", "rotation", F.col("seq").cast("long").alias("seq"), *(whole(F.col("p")[i]).alias(n) for i, n in enumerate(names)), F.trim(F.col("p")[10]).try_cast("double").alias("conf"), F.coalesce(F.get("p", F.lit(11)), F.lit("")).alias("text"))
    return rows.where(" and ".join(f"{n} is not null" for n in [*names, "conf"]))


# Bounds and defaults of the settings, in metres.
SETTINGS = {"wall_height": (1.0, 10.0, 2.5), "default_thickness": (0.05, 1.0, 0.2), "door_height": (1.5, 4.0, 2.0), "window_height": (0.3, 4.0, 1.2), "sill_height": (0.0, 2.5, 0.9)}


def settings(raw: DataFrame) -> DataFrame:
    """Checked settings from (plan_id, json): decimal commas, defaults beyond the bounds, at most 12
    storeys, first of each name, names of at most 20 characters; a lone ground floor if none is left."""
    parsed = F.from_json("json", "wall_height string, default_thickness string, door_height string, window_height string, sill_height string, auto_thickness boolean, plan_storey string, storeys array<struct<name:string,height:string>>")
    df = raw.select("plan_id", parsed.alias("s"))

    def number(c: Column, low: float, high: float, default: float) -> Column:
        v = F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
        return F.when(v.between(low, high), v).otherwise(F.lit(default))

    named = F.filter(F.transform("s.storeys", lambda r: F.struct(F.substring(F.trim(r["name"]), 1, 20).alias("name"), number(r["height"], 1.5, 10.0, 2.8).alias("height"))), lambda r: F.coalesce(r["name"], F.lit("")) != "")
    first = F.filter(named, lambda r, i: F.array_position(F.transform(named, lambda q: q["name"]), r["name"]) == i + 1)
    rows = F.slice(F.coalesce(first, F.array().cast("array<struct<name:string,height:double>>")), 1, 12)
    rows = F.when(F.size(rows) > 0, rows).otherwise(F.array(F.struct(F.lit("EG").alias("name"), F.lit(2.8).alias("height"))))
    values = [number(F.col(f"s.{k}"), *v).alias(k) for k, v in SETTINGS.items()]
    out = df.select("plan_id", *values, F.coalesce("s.auto_thickness", F.lit(True)).alias("auto_thickness"), rows.alias("storeys"), F.col("s.plan_storey").alias("wanted"))
    return out.withColumn("plan_storey", F.when(F.array_contains(F.transform("storeys", lambda r: r["name"]), F.col("wanted")), F.col("wanted")).otherwise("auto")).drop("wanted")


def calibration(raw: DataFrame) -> DataFrame:
    """(plan_id, mm_per_px) from (plan_id, json, width, height, matrix): two points in shares of the
    original picture and the length between them; null unless they are 10 px apart and the length positive."""
    c = F.from_json("json", "p1 array<double>, p2 array<double>, length_m double")
    df = raw.withColumn("c", c)
    p = [homography(F.col("matrix"), F.col(f"c.{k}")[0] * F.col("width"), F.col(f"c.{k}")[1] * F.col("height")) for k in ("p1", "p2")]
    d = F.hypot(p[0]["x"] - p[1]["x"], p[0]["y"] - p[1]["y"])
    return df.select("plan_id", F.when((d > 10) & (F.col("c.length_m") > 0), F.col("c.length_m") * 1000 / d).alias("mm_per_px"))


def training_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata lines of a training set; rows with an error keep it."""
    return spark.read.schema("split string, name string, idx long, wall_px double, theta double, shape array<long>, error string").json(path)
