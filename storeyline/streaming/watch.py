"""Plans that arrive while the job runs: a folder of OCR tables as a stream.

The reference batch functions run on each micro-batch; nothing is kept between batches but the
file source's own log, so a restart from the checkpoint repeats at most one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ocr_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """(plan_id, rotation, tsv) from files named <plan_id>_<rotation>.tsv; others are left out."""
    df = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_a_batch).load(path)
    name = F.col("_metadata.file_name")
    df = df.select(F.regexp_extract(name, r"^(\d+)_(0|90)\.tsv$", 1).try_cast("long").alias("plan_id"), F.regexp_extract(name, r"^(\d+)_(0|90)\.tsv$", 2).try_cast("int").alias("rotation"), F.col("value").alias("tsv"))
    return df.where("plan_id is not null")


def run_batches(stream: DataFrame, batch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False):
    """Writes ``batch`` of every micro-batch below ``out``, a folder a batch: a repeated one overwrites its own."""

    def write(df: DataFrame, number: int) -> None:
        batch(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
