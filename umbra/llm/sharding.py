"""Contiguous shards of equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.common import discard, materialise, tasks_for, whole_ids


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut ``docs``, in the order of ``id_col``, into ``n_shards`` runs of nearly equal bytes.

    1. Write small rows (id, size, checksum, number), the only pass over the texts,
       then range-partition these and write them with the number of their range.
    2. Total the bytes and rows of each range; a running sum over the ranges
       (one row each) gives what lies before it.
    3. Inside each range a running sum gives every row's global byte offset; the
       middle of the row over the equal target names its shard.

    Only step 2's table, a row per range, meets in one task. A row's size is the
    UTF-8 bytes of its text plus 1 (null: 1). Law ``bytes``: a shard differs from
    its equal share by less than one row at either end. Equal texts are not kept
    together, since shards are contiguous in the id. Null ids come first, repeated
    rows count each time, an empty table gives no rows, other columns aren't read,
    texts of any length count whole.

    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each
    shard, in order), grown_shard (null: the law has no growth).
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(whole_ids(docs, id_col).alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("nr"))
    parts = tasks_for(rows, 256 << 20)
    rows = materialise(rows, "sizes")
    # The number last, so that ranges can part even a crowd of identical rows.
    order = ["doc_id", "text_crc32", "size", "nr"]
    ranged = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    held = materialise(ranged, "ranges")
    discard(rows)

    totals = held.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("part")
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_size").over(every).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    # A row per range, at most 200,000 of them: safe to broadcast.
    placed = (
        held.withColumn("ran", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(starts), "part")
        .withColumn("offset", F.col("bytes_before") + F.col("ran") - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.col("nth") - 1)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"((2 * offset + size) * {int(n_shards)}L) div (2 * all_bytes)")).cast("int"))
    )
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "placed")
    discard(held)
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
