"""Page logs and file catalogs made from the driver's tables, integers only, as DataFrames and as SQL.

``events`` is read as a write-ahead log: ten events are a transaction, user_id is the page, the last event of a transaction
commits it. Each transaction is also a log file of level 0; wider files stand above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Events per transaction.
PER = 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_index, txid, page_number, commit_pages, payload, size, salt)"""
    e = read(spark, sf_dir, "events")
    pages = F.broadcast(e.agg((F.max("user_id") + 1).alias("p")))
    txid = F.floor(F.col("event_id") / PER) + 1
    commit = F.when(F.col("event_id") % PER == PER - 1, F.col("p") - txid % (F.floor(F.col("p") / 5) + 1)).otherwise(0)
    return e.join(pages).select(F.col("event_id").alias("frame_index"), txid.alias("txid"), (F.col("user_id") + 1).alias("page_number"), commit.alias("commit_pages"), F.col("value").alias("payload"), F.length("props").cast("bigint").alias("size"), F.col("event_type").alias("salt"))


FRAMES = """frames AS (
  SELECT event_id AS frame_index, event_id // 10 + 1 AS txid, user_id + 1 AS page_number,
         CASE WHEN event_id % 10 = 9 THEN p - (event_id // 10 + 1) % (p // 5 + 1) ELSE 0 END AS commit_pages,
         value AS payload, CAST(length(props) AS BIGINT) AS size, event_type AS salt
  FROM events, (SELECT max(user_id) + 1 AS p FROM events)
)"""


def headers(f: DataFrame) -> DataFrame:
    """One row per committed transaction: (input_ordinal, commit, min_txid, max_txid, size_bytes, checksums)."""
    h = f.groupBy("txid").agg(F.max("commit_pages").alias("commit"), F.sum("size").alias("size_bytes"), F.count("*").alias("frames")).where("commit > 0")
    mix = lambda t: (t * 7919) % 104729
    # every 97th transaction carries a wrong pre-checksum: a break to find
    pre = F.when(F.col("txid") == 1, F.lit(0)).when(F.col("txid") % 97 == 0, mix(F.col("txid"))).otherwise(mix(F.col("txid") - 1))
    return h.select(F.col("txid").alias("input_ordinal"), "commit", F.col("txid").alias("min_txid"), F.col("txid").alias("max_txid"), "size_bytes", pre.alias("pre_apply_checksum"), mix(F.col("txid")).alias("post_apply_checksum"), F.lit(0).alias("flags"), (F.col("txid") * 1000).alias("timestamp_ms"), F.lit(4096).alias("page_size"))


HEADERS = """headers AS (
  SELECT txid AS input_ordinal, max(commit_pages) AS "commit", txid AS min_txid, txid AS max_txid, CAST(sum(size) AS BIGINT) AS size_bytes,
         CASE WHEN txid = 1 THEN 0 WHEN txid % 97 = 0 THEN (txid * 7919) % 104729 ELSE ((txid - 1) * 7919) % 104729 END AS pre_apply_checksum,
         (txid * 7919) % 104729 AS post_apply_checksum, txid * 1000 AS timestamp_ms, 4096 AS page_size
  FROM frames GROUP BY txid HAVING max(commit_pages) > 0
)"""


def pages(f: DataFrame) -> DataFrame:
    """One row per transaction and page, its last frame: (input_ordinal, page_number, frame_index, payload, page_checksum)."""
    newest = f.groupBy("txid", "page_number").agg(F.max("frame_index").alias("frame_index"))
    rows = f.drop("txid", "page_number").join(newest, "frame_index")
    ck = F.lit(-(1 << 63)).bitwiseOR((F.col("frame_index") * 2654435761 + F.col("page_number")).cast("bigint"))
    return rows.select(F.col("txid").alias("input_ordinal"), "page_number", "frame_index", "payload", ck.alias("page_checksum"))


PAGES = """pages AS (
  SELECT txid AS input_ordinal, page_number, frame_index, payload,
         (frame_index * 2654435761 + page_number) | (-9223372036854775807 - 1) AS page_checksum
  FROM (SELECT *, row_number() OVER (PARTITION BY txid, page_number ORDER BY frame_index DESC) AS rn FROM frames) WHERE rn = 1
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog. With n transactions: level 1 files of n/33, level 2 of n/5, snapshots to 3n/10 and 6n/10, and level 0
    from n/4 on."""
    h = headers(frames(spark, sf_dir)).select("max_txid", "size_bytes")
    n = F.broadcast(h.agg(F.max("max_txid").alias("n")))
    h = h.join(n).withColumn("w1", F.greatest(F.floor(F.col("n") / 33), F.lit(2))).withColumn("w2", F.greatest(F.floor(F.col("n") / 5), F.lit(4)))
    out = h.where(F.col("max_txid") > F.floor(F.col("n") / 4)).select(F.lit(0).alias("level"), F.col("max_txid").alias("min_txid"), "max_txid", "size_bytes")
    for level, w in ((1, "w1"), (2, "w2")):
        g = h.groupBy(F.floor((F.col("max_txid") - 1) / F.col(w)).alias("g"), w).agg(F.min("max_txid").alias("min_txid"), F.max("max_txid").alias("max_txid"), F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("c"))
        out = out.union(g.where(F.col("c") == F.col(w)).select(F.lit(level), "min_txid", "max_txid", "size_bytes"))
    for tenths in (3, 6):
        s = h.where(F.col("max_txid") <= F.floor(F.col("n") * tenths / 10)).agg(F.min("max_txid").alias("min_txid"), F.max("max_txid").alias("max_txid"), F.sum("size_bytes").alias("size_bytes"))
        out = out.union(s.select(F.lit(9), "min_txid", "max_txid", "size_bytes"))
    return out.withColumn("created_at_ms", F.lit(None).cast("bigint"))


FILES = """h AS (SELECT max_txid, size_bytes, n, greatest(n // 33, 2) AS w1, greatest(n // 5, 4) AS w2 FROM headers, (SELECT max(max_txid) AS n FROM headers)),
files AS (
  SELECT 0 AS level, max_txid AS min_txid, max_txid, size_bytes FROM h WHERE max_txid > n // 4
  UNION ALL SELECT 1, min(max_txid), max(max_txid), CAST(sum(size_bytes) AS BIGINT) FROM h GROUP BY (max_txid - 1) // w1, w1 HAVING count(*) = w1
  UNION ALL SELECT 2, min(max_txid), max(max_txid), CAST(sum(size_bytes) AS BIGINT) FROM h GROUP BY (max_txid - 1) // w2, w2 HAVING count(*) = w2
  UNION ALL SELECT 9, min(max_txid), max(max_txid), CAST(sum(size_bytes) AS BIGINT) FROM h WHERE max_txid <= n * 3 // 10
  UNION ALL SELECT 9, min(max_txid), max(max_txid), CAST(sum(size_bytes) AS BIGINT) FROM h WHERE max_txid <= n * 6 // 10
)"""
