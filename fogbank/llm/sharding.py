"""Contiguous shards of near-equal bytes (operator 4), with DataFrame operations only.

The rows are range-partitioned by id, each partition sums its bytes, and the totals of the earlier partitions
(one row per partition) start its running sum: a global prefix sum without a global window. A document goes to the
shard whose equal share of all bytes holds its middle byte, so shards are contiguous in id order and each differs
from the target by at most the longest document. No group is kept together: a hot source or a large group of
equal texts is spread over shards like any other rows.

Null text counts 1 byte (its separator) and has crc 0; repeated rows each get a slot; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fogbank.llm.common import documents, durable


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = durable(
        narrow.repartitionByRange("doc_id", "text_crc32", "size").withColumn("part", F.spark_partition_id())
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    # One row per partition: bounded by the partition count, whatever the documents hold.
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = "2 * (bytes_before + running) - size"
    indexed = (
        placed.withColumn("running", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(offsets), "part")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("rows_before") + F.col("nth") - 1).alias("row_index"),
            F.expr(
                f"CAST((CAST({middle} AS DECIMAL(28,0)) * {int(n_shards)}) div CAST(2 * all_bytes AS DECIMAL(28,0)) AS INT)"
            ).alias("shard"),
        )
    )
    firsts = indexed.groupBy("shard").agg(F.min("row_index").alias("first_index"))
    return indexed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row_index") - F.col("first_index")).alias("slot")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: DuckDB has no crc32: the table is computed from the polynomial, the sum folded over the bytes.
CRC32_SQL = """crc_step AS (SELECT i, i AS c FROM range(256) t(i)),
crc_table AS (
  SELECT list(c8 ORDER BY i) AS tab FROM (
    SELECT i, CASE WHEN c7 & 1 = 1 THEN xor(3988292384::BIGINT, c7 >> 1) ELSE c7 >> 1 END AS c8 FROM (
    SELECT i, CASE WHEN c6 & 1 = 1 THEN xor(3988292384::BIGINT, c6 >> 1) ELSE c6 >> 1 END AS c7 FROM (
    SELECT i, CASE WHEN c5 & 1 = 1 THEN xor(3988292384::BIGINT, c5 >> 1) ELSE c5 >> 1 END AS c6 FROM (
    SELECT i, CASE WHEN c4 & 1 = 1 THEN xor(3988292384::BIGINT, c4 >> 1) ELSE c4 >> 1 END AS c5 FROM (
    SELECT i, CASE WHEN c3 & 1 = 1 THEN xor(3988292384::BIGINT, c3 >> 1) ELSE c3 >> 1 END AS c4 FROM (
    SELECT i, CASE WHEN c2 & 1 = 1 THEN xor(3988292384::BIGINT, c2 >> 1) ELSE c2 >> 1 END AS c3 FROM (
    SELECT i, CASE WHEN c1 & 1 = 1 THEN xor(3988292384::BIGINT, c1 >> 1) ELSE c1 >> 1 END AS c2 FROM (
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END AS c1 FROM crc_step))))))))
)"""

OP4_SQL = f"""WITH {CRC32_SQL},
sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(
      regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc_table
),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM sized
),
cut AS (SELECT *, ((2 * upto - size) * 8 // (2 * total))::INTEGER AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM cut"""
