"""Sharding by bytes: contiguous shards of near equal size, from global prefix sums.

The rows are put into id order over range partitions. Only the totals of the partitions are summed up
in order (one row a partition); each row then adds what lies before it in its own partition. A row goes
to the shard in whose share of the bytes its middle lies, so no shard differs from the target by more
than one row's size. Texts are read once, for their length and checksum, which are kept in the shared folder; they are
never shuffled.

Defined results: a null text counts 0 bytes (plus the overhead) and has the checksum of the empty text.
Null ids come first. Rows of equal id, checksum and size are interchangeable. An empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import checkpointed, shuffle_parts


def byte_shards(docs: DataFrame, n_shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, size, text_crc32, law, shard, slot, grown_shard; one row for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = checkpointed(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    order = ["doc_id", "text_crc32", "size"]
    ranged = checkpointed(sized.repartitionByRange(shuffle_parts(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.partitionBy(F.lit(1))).alias("all_bytes"),
    )  # as many rows as range partitions
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.select("*", F.sum("size").over(inside).alias("to_here"), F.count("*").over(inside).alias("row_here"))
        .join(F.broadcast(parts), "part")
        .select(*order, (F.col("rows_before") + F.col("row_here") - 1).alias("at"), F.expr(f"(2 * (bytes_before + to_here) - size) * {n_shards} div (2 * all_bytes)").cast("int").alias("shard"))
    )
    placed = checkpointed(placed)  # read twice
    first = placed.groupBy("shard").agg(F.min("at").alias("first_at"))  # n_shards rows at most
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first_at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


#: crc32 has no function in DuckDB: the checksum is folded over the bytes with a table made by its rule.
_CRC = """
crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0,0,0,0,0,0,0,0]::BIGINT[]),
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
bytes AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 16), lambda i: ('0x' || h[2*i+1:2*i+2])::BIGINT)),
  lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::BIGINT])), 4294967295) AS text_crc32 FROM bytes, crc_table)
"""

ORACLE = f"""
WITH {_CRC},
placed AS (SELECT *, row_number() OVER w - 1 AS pos, (2 * sum(size) OVER w - size) * 40 // (2 * sum(size) OVER ()) AS shard
  FROM summed WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard, (pos - min(pos) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM placed
"""
