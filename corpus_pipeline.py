"""The corpus pipeline: five stages from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of ``documents``; the last returns the pieces of the packed sequences. Between stages the
rows are written to shared storage and read again. Nulls in any column pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeyline.llm import decontam, neardup, packing, pii, tokens, toxicity
from storeyline.llm.common import bounded_batches, crc_mod, free_name, table, written

VOCABULARY = "word_bpe_49k.json"
#: Percent of shared five-word shingles from which documents are near duplicates.
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the calibrated threshold; rows without text stay."""
    bounded_batches(spark)
    model = toxicity.trained(toxicity.sample(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0))
    score = free_name(docs, "score")
    found = toxicity.scored(docs, F.col("text"), [F.col(f"`{c}`") for c in docs.columns], model, score)
    return found.where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest id; rows without an id stay.

    Every row counts by its own text, so rows that share an id but not their texts all stay. Texts
    without words are near to nothing; rows equal in id and such a text become one. Which of several
    rows of the smallest id stays follows their order in the written table."""
    bounded_batches(spark)
    row = free_name(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = neardup.near_duplicates(rows.where("doc_id is not null").select(F.col(row).alias("doc_id"), "text"), percent=NEAR)
    found = found.select(F.col("doc_id").alias("r"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("g"))
    own = rows.where("doc_id is not null").select(F.col(row).alias("r"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    own = own.join(found.hint("shuffle_hash"), "r")
    # with words: one row a group; without: one row an id and text
    wordless = F.col("g").isNull()
    keys = ["g", F.when(wordless, F.col("id")).alias("i"), F.when(wordless, F.col("h")).alias("t")]
    kept = own.groupBy(*keys).agg(F.min(F.struct("id", "r")).alias("least")).select(F.col("least.r").alias(row))
    return rows.where("doc_id is not null").join(kept.hint("shuffle_hash"), row, "left_semi").unionByName(rows.where("doc_id is null")).drop(row)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bounded_batches(spark)
    return decontam.clean(docs, "text", table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars is the new length."""
    bounded_batches(spark)
    spans, text = free_name(docs, "spans"), free_name(docs, "redacted")
    found = pii.personal_data(docs, F.col("text"), [F.col(f"`{c}`") for c in docs.columns if c != "text"], redact=True, names=(spans, text))
    new = {"text": F.col(text), "n_chars": F.coalesce(F.length(text).cast("long"), F.col("n_chars"))}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens."""
    bounded_batches(spark)
    pieces = packing.packed(docs, tokens.tokenizer_path(VOCABULARY))
    return pieces.select("doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: Hashing, training and alignment have no SQL form; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs)
    return docs
