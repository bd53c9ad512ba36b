"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are cut down to their size and checksum before anything is shuffled, put
in global order by a range partitioning, and written once to the shared folder
with the number of their partition, so that totals and running sums are taken
from the same partitions whatever is retried.  Only one row for each partition
(its totals) is gathered to turn local running sums into global ones.  A row
belongs to the shard in which the middle of its bytes falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collatio.llm.common import cut

#: Bytes added to each text's length.
OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, n_shards: int, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Shards are contiguous in the order (id, crc, size), null ids first; size is
    the UTF-8 length of the text (null: 0) plus overhead; a shard's bytes differ
    from the equal share by less than the largest row on either end.  slot
    numbers a shard's rows from 0 without gaps; rows alike in id, crc and size
    are interchangeable.  With fewer rows than shards some shards stay empty; a
    row longer than a share leaves its neighbours short.  grown_shard is null:
    this law moves rows when the number of shards changes.  The crc32 of a null
    text is that of an empty one.  An empty table gives an empty table.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        # splits runs of rows that are alike in all else
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["id", "crc", "size", "row"]
    placed = cut(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))

    # one row for each partition, however many documents there are
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    bases = F.broadcast(
        totals.select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base_bytes"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_rows"),
            F.sum("bytes").over(everything).alias("all_bytes"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", F.coalesce(F.sum("size").over(running), F.lit(0)).alias("lead"), (F.row_number().over(inside) - 1).alias("nth"))
    summed = local.join(bases, "part").select(
        "id", "size", "crc",
        (F.col("base_rows") + F.col("nth")).alias("at"),
        F.least(
            F.lit(n_shards - 1),
            F.expr(f"(2 * (base_bytes + lead) + size) * {int(n_shards)} div (2 * all_bytes)"),
        ).cast("int").alias("shard"),
    )
    # n_shards rows at most
    first = F.broadcast(summed.groupBy("shard").agg(F.min("at").alias("first")))
    return summed.join(first, "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


# The crc table and the fold below are the plain definition of crc32 over UTF-8 bytes.
ORACLE_SQL = """
WITH poly AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
sized AS (
  SELECT doc_id, coalesce(text, '') AS txt, strlen(coalesce(text, '')) + 16 AS size FROM documents),
summed AS (
  SELECT doc_id, txt, size,
         sum(size) OVER (ORDER BY doc_id) - size AS lead_bytes,
         sum(size) OVER () AS total,
         row_number() OVER (ORDER BY doc_id) AS pos
  FROM sized),
placed AS (
  SELECT doc_id, size, pos, least(39, (2 * lead_bytes + size) * 40 // (2 * total))::INT AS shard FROM summed),
bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(txt)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM sized),
sums AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM bytes, poly)
SELECT placed.doc_id, size::BIGINT AS size, crc AS text_crc32,
       'bytes' AS law, shard,
       (pos - min(pos) OVER (PARTITION BY shard))::BIGINT AS slot,
       NULL::INT AS grown_shard
FROM placed JOIN sums USING (doc_id)
"""
