"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of documents. A round is one window: it gives each queue credit in
proportion to its target share; a queue sends the whole tokens that its credit covers, cutting a
document where it ends, and carries what is left over, its deficit, into the next round. After r
rounds queue s has sent floor(r * credit_s + phase_s) tokens, credit_s being its share of a window:
carried deficits, over any number of windows and partitions, are the remainder in this formula and
need no sequential pass. The phase, a fraction hashed from the source, keeps queues of equal shares
from rounding up in the same rounds. Rounds in order, sources in order within a round, make one
stream; it is cut every ``window`` tokens. Only the last sequence can need padding.

What a queue sends in one round is a cell. Cells follow from the queues' totals alone; a queue with
less than a token of credit has one for each token, so there are never more cells than tokens. Prefix
sums in two levels give documents their places in a queue (by input partition) and rounds theirs
in the stream (by block of rounds); no group grows with a queue, however hot.

Defined results: a null text is the empty document, which is its closing id alone; a null source is
a queue of its own; repeated rows are separate documents; an empty table gives no piece. Without
given targets each queue's share is its share of all tokens, so that all end in the same round.
Given targets hold until a queue is empty; sources without a target share what one unit would get.
Neighbouring pieces of a document that meet in the stream are one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeyline.llm.common import column_or_null, held, written
from storeyline.llm.encode import WordIds

WINDOW = 4096
#: ``placed``, which keeps documents whole, holds the mixture over so many windows.
WINDOWS_A_ROUND = 16
ROUNDS_A_BLOCK = 1024
#: Cells of a queue that are kept in one row.
CELLS = 64


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """row, doc_id, source, n, ids (little-endian, 16 bits where all ids fit), in shared storage."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(column_or_null(docs, "source", "string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(("packing", path), lambda: WordIds(path))
        close, narrow = end_id.to_bytes(4, "little"), max(own.largest, end_id) < 1 << 16
        for batch in batches:
            ids = [x + close for x in own(batch.column(2).to_pylist())]
            n = [len(x) // 4 for x in ids]
            if narrow:
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "n", "ids"])

    return written(source.mapInArrow(run, "doc_id long, source string, n long, ids binary").withColumn("row", F.monotonically_increasing_id()))


def _queued(rows: DataFrame, window: float, targets: dict[str, float] | None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``end``, where each ends in its queue, and credit and phase; source, source_n, credit, a
    round's tokens, and phase). Rows meet their queue by input partition, never as a whole queue."""
    rows = rows.select("row", "source", "n", F.shiftrightunsigned("row", 33).alias("part"))
    parts = rows.groupBy("source", "part").agg(F.sum("n").alias("part_n"))
    queue = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_n").over(queue), F.lit(0)))
    totals = rows.groupBy("source").agg(F.sum("n").alias("source_n"))
    if targets is None:
        total = rows.agg(F.sum("n").alias("all_n"))
        totals = totals.join(F.broadcast(total)).withColumn("credit", F.col("source_n") / F.col("all_n") * window).drop("all_n")  # one row
    else:
        whole = float(sum(targets.values())) or 1.0
        least = min([v for v in targets.values() if v > 0], default=1.0)
        share = F.coalesce(*(F.when(F.col("source") == k, F.lit(float(v) if v > 0 else least)) for k, v in targets.items()), F.lit(1.0))
        totals = totals.withColumn("credit", share / whole * window)
    totals = totals.withColumn("phase", F.pmod(F.xxhash64("source"), F.lit(1 << 30)) / float(1 << 30))
    parts = parts.join(totals, "source").select("source", "part", "before", "credit", "phase")
    inside = Window.partitionBy("source", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("n").over(inside)).join(parts, ["source", "part"])
    return rows.select("row", "source", "n", (F.col("before") + F.col("end")).alias("end"), "credit", "phase"), totals


def _round_starts(rows: DataFrame) -> DataFrame:
    """(round, round_at): where each round begins in the stream; ``rows`` has round and n."""
    rounds = rows.groupBy("round").agg(F.sum("n").alias("round_n")).withColumn("block", F.floor(F.col("round") / ROUNDS_A_BLOCK))
    blocks = rounds.groupBy("block").agg(F.sum("round_n").alias("block_n"))
    blocks = blocks.withColumn("block_at", F.coalesce(F.sum("block_n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "block_at")
    rounds = rounds.withColumn("in_block", F.coalesce(F.sum("round_n").over(Window.partitionBy("block").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rounds.join(blocks, "block").select("round", (F.col("block_at") + F.col("in_block")).alias("round_at"))


def placed(rows: DataFrame, window: int = WINDOW, targets: dict[str, float] | None = None, windows_a_round: int = WINDOWS_A_ROUND) -> DataFrame:
    """(row, at): where each document begins in a stream of whole documents, whose mixture holds over
    rounds only; ``rows`` has row, source, n. ``packed`` cuts documents instead, see ``cells``."""
    rows, _ = _queued(rows, float(window * windows_a_round), targets)
    rows = rows.select("row", "source", "n", F.ceil(F.col("end") / F.col("credit")).alias("round"))
    here = Window.partitionBy("round").orderBy("source", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_round", F.coalesce(F.sum("n").over(here), F.lit(0))).join(_round_starts(rows), "round")
    return rows.select("row", (F.col("round_at") + F.col("in_round")).alias("at"))


def _sent(rounds: Column) -> Column:
    """The tokens a queue has sent after so many rounds, were it endless."""
    return F.floor(rounds * F.col("credit") + F.col("phase"))


def _cell(token: Column) -> Column:
    """The number of the cell that holds a queue's token: with a token of credit or more the round, else the token."""
    guess = F.ceil((token + 1 - F.col("phase")) / F.col("credit")) - 1  # within one, for roundings
    exact = guess - (_sent(guess) > token).cast("long") + (_sent(guess + 1) <= token).cast("long")
    return F.when(F.col("credit") >= 1, exact).otherwise(token)


def cells(rows: DataFrame, window: int = WINDOW, targets: dict[str, float] | None = None) -> DataFrame:
    """row, end and its cells [(from, at)]: the queue's token ``from`` and all up to the next cell begin at
    ``at`` in the stream; ``rows`` has row, source, n."""
    rows, totals = _queued(rows, float(window), targets)
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = totals.withColumn("last", _cell(F.col("source_n") - 1)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / CELLS))))
    made = made.repartition(spread, "source", "block").withColumn("cell", F.explode(F.sequence(F.col("block") * CELLS, F.least("last", F.col("block") * CELLS + CELLS - 1))))
    whole = F.col("credit") >= 1
    made = made.withColumn("from", F.when(whole, _sent(F.col("cell"))).otherwise(F.col("cell")))
    made = made.withColumn("n", F.when(whole, F.least(_sent(F.col("cell") + 1), "source_n") - F.col("from")).otherwise(F.lit(1)).cast("long"))
    made = made.select("source", "block", "from", "n", F.when(whole, F.col("cell") + 1).otherwise(F.ceil((F.col("cell") + 1 - F.col("phase")) / F.col("credit"))).alias("round"))
    here = Window.partitionBy("round").orderBy("source", "from").rowsBetween(Window.unboundedPreceding, -1)
    at = made.withColumn("in_round", F.coalesce(F.sum("n").over(here), F.lit(0))).join(_round_starts(made), "round")
    at = at.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("from", (F.col("round_at") + F.col("in_round")).alias("at")))).alias("cells"))
    # a document meets the rows of cells it reaches into and takes its own
    rows = rows.select("row", "source", "end", _cell(F.col("end") - F.col("n")).alias("first"), _cell(F.col("end") - 1).alias("last"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / CELLS), F.floor(F.col("last") / CELLS))))
    skip = F.greatest(F.col("first") - F.col("block") * CELLS, F.lit(0)).cast("int")
    upto = F.least(F.col("last") - F.col("block") * CELLS + 1, F.lit(CELLS)).cast("int")
    own = rows.join(at, ["source", "block"]).select("row", "end", F.slice("cells", skip + 1, upto - skip).alias("cells"))
    return own.groupBy("row", "end").agg(F.flatten(F.collect_list("cells")).alias("cells"))


def pieces(n: np.ndarray, begin: np.ndarray, froms: pa.Array, ats: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, place in the stream) of each piece; documents of ``n`` tokens that begin
    at ``begin`` in their queues and have the cells ``froms`` and ``ats``, in any order."""
    of = np.repeat(np.arange(len(n)), pc.list_value_length(froms).to_numpy())
    start, at = froms.flatten().to_numpy() - begin[of], ats.flatten().to_numpy()
    order = np.lexsort((start, of))
    start, at = start[order], at[order]
    start, at = np.maximum(start, 0), at + np.maximum(-start, 0)  # the first cell may begin before the document
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (at[1:] - at[:-1] != start[1:] - start[:-1])))
    of, start, at = of[new], start[new], at[new]
    length = np.where(np.append(of[1:] == of[:-1], False), np.append(start[1:], 0), n[of]) - start
    times = (at + length - 1) // window - at // window + 1
    cut = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    of, start, at, end = np.repeat(of, times), np.repeat(start, times), np.repeat(at, times), np.repeat(at + length, times)
    low = np.maximum(at, (at // window + cut) * window)
    return of, start + low - at, np.minimum(end, (at // window + cut + 1) * window) - low, low


def packed(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, targets: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    on request, ids. Ids are shuffled once, to meet their places."""
    rows = tokenised(docs, path, end_id)
    own = cells(rows, window, targets).select("row", "end", F.col("cells.from").alias("from"), F.col("cells.at").alias("at"))
    both = rows.select("row", "doc_id", "source", "n", "ids").join(own, "row").select("doc_id", "source", "n", "ids", "end", "from", "at")
    names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(2).to_numpy()
            of, start, length, at = pieces(n, batch.column(4).to_numpy() - n, batch.column(5), batch.column(6), window)
            raw = b"".join(batch.column(3).to_pylist())
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n.sum() else "<u4").astype("<u4")
            low = (np.cumsum(n) - n)[of] + start
            parts, view = list(zip(low.tolist(), (low + length).tolist(), strict=True)), memoryview(ids)
            crc = [zlib.crc32(view[a:b]) for a, b in parts]
            who = pa.array(of)
            columns = [batch.column(0).take(who), batch.column(1).take(who), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[of]), pa.array(at // window), pa.array(at % window)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([ids[a:b] for a, b in parts], pa.list_(pa.int32()))] * with_ids], names=[*names, *["ids"] * with_ids])

    return both.mapInArrow(run, schema)
