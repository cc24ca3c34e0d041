"""Registered queries and their SQL twins: each query is the library's operator over the tables of `tables`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelog.functions import exprs
from pagelog.operators import catalog, merge, prefix, validate
from pagelog.plans import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None, ctes: tuple[str, ...] = (), recursive: bool = False):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = (f"WITH {'RECURSIVE ' * recursive}{', '.join(ctes)} " if ctes else "") + sql
        return f

    return register


_F, _H, _P = (T.FRAMES,), (T.FRAMES, T.HEADERS), (T.FRAMES, T.HEADERS, T.PAGES)
_C = (T.FRAMES, T.HEADERS, T.FILES)
_LAST = "(SELECT max(frame_index) FROM frames WHERE commit_pages > 0)"
_COMMIT = f"(SELECT commit_pages FROM frames WHERE frame_index = {_LAST})"
_FINAL = '(SELECT "commit" FROM headers ORDER BY input_ordinal DESC LIMIT 1)'
#: A range of transactions that is treated as one chain.
_CHAIN = "(SELECT max(input_ordinal) // 2 FROM headers)"


# Write-ahead log


@_query("wal_page_map", f"SELECT page_number, frame_index, payload FROM (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY frame_index DESC) AS rn FROM frames WHERE frame_index <= {_LAST}) WHERE rn = 1 AND page_number <= {_COMMIT}", _F)
def wal_page_map(spark, d):
    return merge.page_map(T.frames(spark, d)).select("page_number", "frame_index", "payload")


@_query("valid_prefix", "SELECT count(*) AS frames, max(frame_index) AS last_frame FROM frames WHERE frame_index < (SELECT min(frame_index) FROM frames WHERE salt = (SELECT max(salt) FROM frames) AND size > (SELECT avg(size) FROM frames))", _F)
def valid_prefix(spark, d):
    f = T.frames(spark, d)
    k = F.broadcast(f.agg(F.max("salt").alias("top"), F.avg("size").alias("mean")))
    bad = (F.col("salt") == F.col("top")) & (F.col("size") > F.col("mean"))
    return merge.valid_prefix(f.join(k), bad).agg(F.count("*").alias("frames"), F.max("frame_index").alias("last_frame"))


@_query("uncommitted_tail", f"SELECT frame_index, page_number FROM frames WHERE frame_index % 10 <> 9 AND frame_index > (SELECT max(frame_index) FROM frames WHERE commit_pages > 0 AND txid < (SELECT max(txid) FROM frames))", _F)
def uncommitted_tail(spark, d):
    f = T.frames(spark, d)
    torn = f.join(F.broadcast(f.agg(F.max("txid").alias("t"))), (F.col("txid") < F.col("t")) | (F.col("commit_pages") == 0)).drop("t")
    return torn.join(merge.committed(torn).select("frame_index"), "frame_index", "left_anti").select("frame_index", "page_number")


@_query("frame_transactions", "SELECT frame_index, CAST(coalesce(sum(CASE WHEN commit_pages > 0 THEN 1 ELSE 0 END) OVER (ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tx FROM frames", _F)
def frame_transactions(spark, d):
    f = T.frames(spark, d)
    return prefix.running(f, "frame_index", F.when(F.col("commit_pages") > 0, 1).otherwise(0).cast("bigint"), "tx", exclusive=True).select("frame_index", F.col("tx").cast("bigint").alias("tx"))


@_query("salt_census", "SELECT salt, min(frame_index) AS first_frame FROM frames GROUP BY salt", _F)
def salt_census(spark, d):
    return merge.salt_census(T.frames(spark, d), ["salt"])


@_query("salts_until", "SELECT salt, min(frame_index) AS first_frame FROM frames WHERE frame_index <= (SELECT min(frame_index) FROM frames WHERE salt = (SELECT max(salt) FROM frames)) GROUP BY salt", _F)
def salts_until(spark, d):
    f = T.frames(spark, d)
    census = merge.salt_census(f, ["salt"])
    until = F.broadcast(census.agg(F.max_by("first_frame", "salt").alias("u")))
    return census.join(until, F.col("first_frame") <= F.col("u")).drop("u")


@_query("commit_end", f"SELECT {_COMMIT} AS commit_pages, {_LAST} AS last_frame, 32 + ({_LAST} + 1) * (24 + 4096) AS end_offset, count(*) AS frame_count FROM frames", _F)
def commit_end(spark, d):
    at = F.when(F.col("commit_pages") > 0, F.col("frame_index"))
    out = T.frames(spark, d).agg(F.max_by("commit_pages", at).alias("commit_pages"), F.max(at).alias("last_frame"), F.count("*").alias("frame_count"))
    return out.withColumn("end_offset", F.lit(exprs.WAL_HEADER) + (F.col("last_frame") + 1) * (exprs.FRAME_HEADER + 4096))


# Merging chains


@_query("newest_wins", "SELECT page_number, input_ordinal, payload FROM (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY input_ordinal DESC) AS rn FROM pages) WHERE rn = 1", _P)
def newest_wins(spark, d):
    return merge.newest_wins(T.pages(T.frames(spark, d))).select("page_number", "input_ordinal", "payload")


@_query("commit_truncate", f"SELECT input_ordinal, page_number FROM pages WHERE page_number <= {_FINAL}", _P)
def commit_truncate(spark, d):
    f = T.frames(spark, d)
    return merge.truncate(T.pages(f), merge.final_commit(T.headers(f))).select("input_ordinal", "page_number")


@_query("compact_chain", f"SELECT page_number, input_ordinal, payload FROM (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY input_ordinal DESC) AS rn FROM pages) WHERE rn = 1 AND page_number <= {_FINAL}", _P)
def compact_chain(spark, d):
    f = T.frames(spark, d)
    return merge.compact(T.pages(f), T.headers(f)).select("page_number", "input_ordinal", "payload")


@_query("replay_chain", f'SELECT p.page_number, p.input_ordinal, p.payload FROM (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY input_ordinal DESC) AS rn FROM pages) p WHERE rn = 1 AND page_number <= {_FINAL} AND NOT EXISTS (SELECT 1 FROM headers h WHERE h.input_ordinal > p.input_ordinal AND h."commit" < p.page_number)', _P)
def replay_chain(spark, d):
    f = T.frames(spark, d)
    return merge.replay(T.pages(f), T.headers(f)).select("page_number", "input_ordinal", "payload")


@_query("apply_overlay", f"SELECT coalesce(d.page_number, b.page_number) AS page_number, CASE WHEN d.page_number IS NULL THEN b.frame_index ELSE d.frame_index END AS frame_index FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY input_ordinal DESC) AS rn FROM pages WHERE input_ordinal <= {_CHAIN}) WHERE rn = 1) b FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY input_ordinal DESC) AS rn FROM pages WHERE input_ordinal > {_CHAIN}) WHERE rn = 1) d ON b.page_number = d.page_number WHERE coalesce(d.page_number, b.page_number) <= {_FINAL}", _P)
def apply_overlay(spark, d):
    f = T.frames(spark, d)
    p, h = T.pages(f), T.headers(f)
    half = F.broadcast(h.agg(F.floor(F.max("input_ordinal") / 2).alias("k")))
    base = merge.newest_wins(p.join(half, F.col("input_ordinal") <= F.col("k")))
    delta = merge.newest_wins(p.join(half, F.col("input_ordinal") > F.col("k")))
    commit = h.agg(F.max_by("commit", "input_ordinal")).first()[0]
    return merge.apply_overlay(base, delta, commit, ["frame_index"])


@_query("zero_fill_pages", f"SELECT i AS page_number, coalesce(m.frame_index, -1) AS frame_index FROM range(1, CAST({_FINAL} + 1 AS BIGINT)) r(i) LEFT JOIN (SELECT page_number, max(frame_index) AS frame_index FROM pages GROUP BY page_number) m ON m.page_number = i", _P)
def zero_fill_pages(spark, d):
    f = T.frames(spark, d)
    h = T.headers(f)
    commit = h.agg(F.max_by("commit", "input_ordinal")).first()[0]
    return merge.zero_fill(merge.compact(T.pages(f), h).select("page_number", "frame_index"), commit, 4096, {"frame_index": F.lit(-1)})


@_query("backfill_pages", "SELECT c.c_custkey + 1 AS page_number, coalesce(m.frame_index, -1 - c.c_custkey) AS frame_index FROM customer c LEFT JOIN (SELECT page_number, max(frame_index) AS frame_index FROM pages GROUP BY page_number) m ON m.page_number = c.c_custkey + 1", _P)
def backfill_pages(spark, d):
    db = T.read(spark, d, "customer").select((F.col("c_custkey") + 1).alias("page_number"), (-1 - F.col("c_custkey")).alias("frame_index"))
    mapped = merge.newest_wins(T.pages(T.frames(spark, d)))
    return merge.backfill(db.select("page_number"), mapped, db, ["frame_index"])


@_query("grown_pages", f"SELECT i AS page_number, coalesce(m.frame_index >= {_LAST} * 9 // 10, false) AS fresh FROM range(1, CAST({_COMMIT} + 1 AS BIGINT)) r(i) LEFT JOIN (SELECT page_number, max(frame_index) AS frame_index FROM frames WHERE frame_index <= {_LAST} GROUP BY page_number) m ON m.page_number = i WHERE coalesce(m.frame_index >= {_LAST} * 9 // 10, false) OR i > {_COMMIT} * 9 // 10", _F)
def grown_pages(spark, d):
    f = T.frames(spark, d)
    at = F.when(F.col("commit_pages") > 0, F.col("frame_index"))
    commit, last = f.agg(F.max_by("commit_pages", at), F.max(at)).first()
    return merge.captured_pages(merge.page_map(f), commit, last * 9 // 10, commit * 9 // 10, 4096)


@_query("db_checksum_xor", f"SELECT bit_xor(page_checksum & 9223372036854775807) | (-9223372036854775807 - 1) AS database_checksum FROM (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY input_ordinal DESC) AS rn FROM pages) WHERE rn = 1 AND page_number <= {_FINAL}", _P)
def db_checksum_xor(spark, d):
    f = T.frames(spark, d)
    return merge.database_checksum(merge.compact(T.pages(f), T.headers(f)), page_size=4096)


@_query("checksum_by_input", "SELECT input_ordinal, bit_xor(page_checksum & 9223372036854775807) | (-9223372036854775807 - 1) AS checksum, count(*) AS pages FROM pages GROUP BY input_ordinal", _P)
def checksum_by_input(spark, d):
    return T.pages(T.frames(spark, d)).groupBy("input_ordinal").agg(exprs.checksum_fold("page_checksum").alias("checksum"), F.count("*").alias("pages"))


@_query("chain_summary", f'SELECT 4096 AS page_size, {_FINAL} AS "commit", min(min_txid) AS min_txid, max(max_txid) AS max_txid, max(timestamp_ms) AS timestamp_ms, (SELECT pre_apply_checksum FROM headers ORDER BY input_ordinal LIMIT 1) AS pre_apply_checksum, count(*) AS inputs FROM headers', _H)
def chain_summary(spark, d):
    return merge.chain_summary(T.headers(T.frames(spark, d)))


@_query("as_of_image", f"SELECT page_number, max(input_ordinal) AS input_ordinal FROM pages WHERE input_ordinal <= {_CHAIN} GROUP BY page_number HAVING page_number <= (SELECT \"commit\" FROM headers WHERE input_ordinal = {_CHAIN}) AND max(input_ordinal) >= coalesce((SELECT max(h.input_ordinal) FROM headers h WHERE h.input_ordinal <= {_CHAIN} AND h.\"commit\" < page_number), 0)", _P)
def as_of_image(spark, d):
    f = T.frames(spark, d)
    h = T.headers(f)
    half = F.broadcast(h.agg(F.floor(F.max("input_ordinal") / 2).alias("k")))
    upto = lambda x: x.join(half, F.col("input_ordinal") <= F.col("k")).drop("k")
    return merge.replay(upto(T.pages(f)), upto(h)).select("page_number", "input_ordinal")


# Validation


@_query("contiguity_breaks", "SELECT b.input_ordinal, 'DivergentHistory' AS fault FROM headers a JOIN headers b ON b.input_ordinal = a.input_ordinal + 1 WHERE b.pre_apply_checksum <> a.post_apply_checksum", _H)
def contiguity_breaks(spark, d):
    return catalog.contiguity_breaks(T.headers(T.frames(spark, d))).select("input_ordinal", "fault")


@_query("page_order_violations", "SELECT frame_index FROM (SELECT *, lag(page_number) OVER (PARTITION BY txid ORDER BY frame_index) AS before FROM frames) WHERE page_number <= before", _F)
def page_order_violations(spark, d):
    return validate.page_order(T.frames(spark, d), "txid", "frame_index").select("frame_index")


@_query("snapshot_completeness", 'SELECT h.input_ordinal, count(p.page_number) AS page_count, max(p.page_number) AS last_page, count(p.page_number) = h."commit" AND max(p.page_number) = h."commit" AS complete FROM headers h LEFT JOIN pages p ON p.input_ordinal = h.input_ordinal GROUP BY h.input_ordinal, h."commit"', _P)
def snapshot_completeness(spark, d):
    f = T.frames(spark, d)
    return validate.snapshot_completeness(T.headers(f), T.pages(f))


@_query("identity_mismatch", "SELECT input_ordinal FROM headers WHERE format('{:016x}', min_txid) <> format('{:016x}', CASE WHEN input_ordinal % 50 = 0 THEN max_txid + 1 ELSE max_txid END)", _H)
def identity_mismatch(spark, d):
    h = T.headers(T.frames(spark, d))
    names = h.select("input_ordinal", exprs.file_name("min_txid", F.when(F.col("input_ordinal") % 50 == 0, F.col("max_txid") + 1).otherwise(F.col("max_txid"))).alias("name"))
    return validate.identity_mismatch(h, names, "input_ordinal").select("input_ordinal")


@_query("header_faults", "SELECT o_orderkey AS id, CASE WHEN flags & ~2 <> 0 THEN 'InvalidHeaderFlags' WHEN NOT (ps BETWEEN 512 AND 65536 AND (ps & (ps - 1)) = 0) THEN 'InvalidPageSize' WHEN lo = 0 OR hi = 0 OR lo > hi THEN 'InvalidTXIDRange' END AS fault FROM (SELECT o_orderkey, o_orderkey % 4 AS flags, CAST(256 AS BIGINT) << CAST(o_orderkey % 10 AS BIGINT) AS ps, o_custkey AS lo, o_custkey + (o_orderkey % 7) - 1 AS hi FROM orders) WHERE flags & ~2 <> 0 OR NOT (ps BETWEEN 512 AND 65536 AND (ps & (ps - 1)) = 0) OR lo = 0 OR hi = 0 OR lo > hi")
def header_faults(spark, d):
    o = T.read(spark, d, "orders")
    zero = F.lit(0).cast("bigint")
    h = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("flags"), F.expr("shiftleft(256L, cast(o_orderkey % 10 as int))").alias("page_size"), F.lit(1).alias("commit"), F.col("o_custkey").alias("min_txid"), (F.col("o_custkey") + F.col("o_orderkey") % 7 - 1).alias("max_txid"),
                 F.when((F.col("o_custkey") == 1) | (F.col("o_orderkey") % 4 >= 2), zero).otherwise(F.lit(-(1 << 63))).alias("pre_apply_checksum"), zero.alias("wal_offset"), zero.alias("wal_size"), zero.alias("wal_salt_1"), zero.alias("wal_salt_2"))
    return validate.headers(h).select("id", "fault")


@_query("trailer_faults", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN nc AND post <> 0 THEN 'InvalidTrailer' WHEN NOT nc AND post >= 0 THEN 'InvalidChecksumFormat' END AS fault FROM (SELECT *, l_linenumber % 2 = 0 AS nc, CASE WHEN l_partkey % 3 = 0 THEN 0 WHEN l_partkey % 3 = 1 THEN -l_partkey ELSE l_partkey END AS post FROM lineitem) WHERE (nc AND post <> 0) OR (NOT nc AND post >= 0)")
def trailer_faults(spark, d):
    post = F.when(F.col("l_partkey") % 3 == 0, 0).when(F.col("l_partkey") % 3 == 1, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    t = T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, 2).otherwise(0).alias("flags"), F.lit(1).alias("commit"), post.alias("post_apply_checksum"), F.lit(-1).cast("bigint").alias("file_checksum"))
    return validate.trailers(t).select("l_orderkey", "l_linenumber", "l_partkey", "fault")


# Scalar surface


@_query("txid_text", "SELECT o_orderkey, format('{:016x}', o_orderkey * 1000003) AS text, o_orderkey * 1000003 AS parsed FROM orders")
def txid_text(spark, d):
    text = exprs.format_txid(F.col("o_orderkey") * 1000003)
    return T.read(spark, d, "orders").select("o_orderkey", text.alias("text")).withColumn("parsed", exprs.parse_txid("text").cast("bigint"))


@_query("file_name_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_custkey = 0 THEN -1 ELSE o_custkey END AS min_txid FROM orders")
def file_name_parse(spark, d):
    o = T.read(spark, d, "orders")
    name = exprs.file_name("o_custkey", F.col("o_custkey") + F.col("o_orderkey"))
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(name, F.lit(".tmp"))).otherwise(name)
    return o.select("o_orderkey", F.coalesce(exprs.parse_file_name(name)["min_txid"].cast("bigint"), F.lit(-1)).alias("min_txid"))


@_query("lock_page", "SELECT n_nationkey, ps, 1073741824 // ps + 1 AS lock_page, (n_nationkey % 9 + 1 - 1) * ps AS page_offset, 1073741824 // ps * ps AS lock_offset FROM (SELECT n_nationkey, CAST(512 AS BIGINT) << CAST(n_nationkey % 8 AS BIGINT) AS ps FROM nation)")
def lock_page(spark, d):
    n = T.read(spark, d, "nation").select("n_nationkey", F.expr("shiftleft(512L, cast(n_nationkey % 8 as int))").alias("ps"))
    return n.select("n_nationkey", "ps", exprs.lock_page("ps").alias("lock_page"), exprs.page_offset(F.col("n_nationkey") % 9 + 1, "ps").alias("page_offset"), exprs.page_offset(exprs.lock_page("ps"), "ps").alias("lock_offset"))


@_query("interval_bucket", "SELECT s - s % 30000 AS bucket, count(*) AS events, max(s - s % 30000 + 30000) AS next_boundary FROM (SELECT epoch_us(ts) // 1000 AS s FROM events) GROUP BY 1")
def interval_bucket(spark, d):
    e = T.read(spark, d, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("s"))
    i = F.lit(30000)
    return e.groupBy(exprs.interval_start("s", i).alias("bucket")).agg(F.count("*").alias("events"), F.max(exprs.interval_next("s", i)).alias("next_boundary"))


@_query("level_boundaries", "SELECT level, count(*) AS boundaries FROM (SELECT DISTINCT l AS level, CASE WHEN i = 0 THEN s ELSE s - s % i END AS b FROM (SELECT epoch_us(ts) // 1000 AS s FROM events), (VALUES (0, 0), (1, 30000), (2, 300000), (3, 3600000)) v(l, i)) GROUP BY level")
def level_boundaries(spark, d):
    ladder = spark.createDataFrame([(x.level, x.interval_ms) for x in catalog.Ladder().levels], "level int, interval_ms bigint")
    e = T.read(spark, d, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("s")).crossJoin(F.broadcast(ladder))
    return e.select("level", exprs.interval_start("s", "interval_ms").alias("b")).distinct().groupBy("level").agg(F.count("*").alias("boundaries"))


@_query("wire_bound", "SELECT p_partkey, 122 + p_size * (10 + 4096 + 4096 // 255 + 16) + p_size * 12 AS bound, CASE WHEN p_size < 15 THEN 1 ELSE 2 + (p_size - 15) // 255 END + p_size AS literal FROM part")
def wire_bound(spark, d):
    return T.read(spark, d, "part").select("p_partkey", exprs.wire_bound("p_size", exprs.compress_bound(F.lit(4096)), F.col("p_size") * 12).cast("bigint").alias("bound"), exprs.literal_bound("p_size").alias("literal"))


@_query("checkpoint_due", "SELECT tx, frames, bytes, frames >= 500 OR bytes >= 20000 OR age >= 600000 AS due FROM (SELECT txid // 50 AS tx, count(*) AS frames, CAST(sum(size) AS BIGINT) AS bytes, max(txid * 1000) - min(txid * 1000) AS age FROM frames GROUP BY 1)", _F)
def checkpoint_due(spark, d):
    g = T.frames(spark, d).groupBy(F.floor(F.col("txid") / 50).alias("tx")).agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"), (F.max(F.col("txid") * 1000) - F.min(F.col("txid") * 1000)).alias("age"))
    return g.select("tx", "frames", "bytes", validate.checkpoint_due(F.lit(False), F.col("bytes"), F.col("frames"), F.col("age"), 20000, 500, 600000).alias("due"))


# Catalog


@_query("level_listing", "SELECT level, min_txid, max_txid, size_bytes FROM files", _C)
def level_listing(spark, d):
    return catalog.listing(T.files(spark, d)).drop("created_at_ms")


@_query("listing_seek", "SELECT level, min_txid, max_txid FROM files WHERE level = 1 AND min_txid >= (SELECT n // 2 FROM h LIMIT 1)", _C)
def listing_seek(spark, d):
    f = T.files(spark, d)
    n = f.where("level = 0").agg(F.max("max_txid")).first()[0]
    return catalog.listing(f, 1, n // 2).select("level", "min_txid", "max_txid")


@_query("listing_faults", "SELECT level, min_txid, max_txid, CASE WHEN level = 0 THEN 'size' END AS fault FROM files WHERE level = 0 AND size_bytes > (SELECT avg(size_bytes) FROM files WHERE level = 0)", _C)
def listing_faults(spark, d):
    f = T.files(spark, d).where("level = 0")
    limit = int(f.agg(F.floor(F.avg("size_bytes"))).first()[0])
    return catalog.listing_faults(f, limit).select("level", "min_txid", "max_txid", "fault")


@_query("newest_snapshot", "SELECT level, min_txid, max_txid, size_bytes FROM files WHERE level = 9 ORDER BY max_txid DESC LIMIT 1", _C)
def newest_snapshot(spark, d):
    return catalog.newest_snapshot(T.files(spark, d)).drop("created_at_ms")


def _plan_sql(target: str) -> str:
    use = f"u AS (SELECT * FROM files WHERE {target} = 0 OR max_txid <= {target})"
    return f"""{use}, best AS (
  SELECT r.reach, f.level, f.min_txid, f.max_txid, row_number() OVER (PARTITION BY r.reach ORDER BY f.max_txid DESC, f.min_txid, f.level DESC) AS rn
  FROM (SELECT DISTINCT max_txid AS reach FROM u UNION SELECT 0) r JOIN u f ON f.level < 9 AND f.min_txid <= r.reach + 1 AND f.max_txid > r.reach
), walk AS (
  SELECT level, min_txid, max_txid FROM (SELECT * FROM u WHERE level = 9 ORDER BY max_txid DESC LIMIT 1)
  UNION ALL SELECT b.level, b.min_txid, b.max_txid FROM walk w JOIN best b ON b.reach = w.max_txid AND b.rn = 1
)"""


@_query("restore_plan_latest", "SELECT level, min_txid, max_txid FROM walk", (*_C, _plan_sql("0")), recursive=True)
def restore_plan_latest(spark, d):
    return catalog.restore_plan(T.files(spark, d)).select("level", "min_txid", "max_txid")


@_query("restore_plan_target", "SELECT level, min_txid, max_txid FROM walk", (*_C, _plan_sql("(SELECT n * 7 // 10 FROM h LIMIT 1)")), recursive=True)
def restore_plan_target(spark, d):
    f = T.files(spark, d)
    n = f.where("level = 0").agg(F.max("max_txid")).first()[0]
    return catalog.restore_plan(f, n * 7 // 10).select("level", "min_txid", "max_txid")


@_query("plan_gap", "SELECT 'NonContiguousPlan' AS error")
def plan_gap(spark, d):
    f = T.files(spark, d)
    n = f.where("level = 0").agg(F.max("max_txid")).first()[0]
    holed = f.where(~((F.col("max_txid") >= n - 2) & (F.col("min_txid") <= n - 2)) | (F.col("level") == 9))
    try:
        catalog.restore_plan(holed)
        found = "none"
    except catalog.PlanError as e:
        found = str(e)
    return spark.createDataFrame([(found,)], "error string")


@_query("compaction_prefix", "SELECT min_txid, max_txid, CAST(running AS BIGINT) AS running_bytes FROM (SELECT *, sum(size_bytes) OVER (ORDER BY min_txid) AS running, row_number() OVER (ORDER BY min_txid) AS rn FROM files WHERE level = 1) WHERE running <= (SELECT sum(size_bytes) // 3 FROM files WHERE level = 1) AND rn <= 12", _C)
def compaction_prefix(spark, d):
    f = T.files(spark, d)
    budget = f.where("level = 1").agg(F.floor(F.sum("size_bytes") / 3)).first()[0]
    chosen, _ = catalog.compaction_plan(f.where("level = 1"), f.where("false"), 12, int(budget))
    return chosen.select("min_txid", "max_txid", "running_bytes")


@_query("retention", "SELECT l.level, l.min_txid, l.max_txid FROM files l WHERE l.level = 0 AND EXISTS (SELECT 1 FROM files u WHERE u.level IN (1, 2) AND u.min_txid <= l.min_txid AND l.max_txid <= u.max_txid)", _C)
def retention(spark, d):
    f = T.files(spark, d)
    return catalog.retention(f.where("level = 0"), f.where("level in (1, 2)")).select("level", "min_txid", "max_txid")


@_query("covered_snapshots", "SELECT level, min_txid, max_txid FROM files WHERE level = 9 AND max_txid < (SELECT max(max_txid) FROM files WHERE level = 9)", _C)
def covered_snapshots(spark, d):
    f = T.files(spark, d)
    newest = catalog.newest_snapshot(f).first()
    return catalog.covered_snapshots(f, newest.min_txid, newest.max_txid).select("level", "min_txid", "max_txid")


@_query("source_after", "SELECT min_txid, max_txid FROM files WHERE level = 0 AND min_txid >= (SELECT min(min_txid) FROM files WHERE level = 0 AND max_txid > (SELECT max(max_txid) // 2 FROM files WHERE level = 2))", _C)
def source_after(spark, d):
    f = T.files(spark, d)
    covered = f.where("level = 2").agg(F.floor(F.max("max_txid") / 2)).first()[0]
    return catalog.source_after(f.where("level = 0"), covered).select("min_txid", "max_txid")


@_query("batch_due", "SELECT level, count(*) >= 10 AS due FROM files GROUP BY level", _C)
def batch_due(spark, d):
    f = T.files(spark, d)
    levels = [r.level for r in f.select("level").distinct().collect()]  # ten at most
    return spark.createDataFrame([(lv, catalog.batch_due(f.where(F.col("level") == lv), 10)) for lv in levels], "level int, due boolean")


@_query("level_totals", "SELECT level, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, max(max_txid) AS reach FROM files GROUP BY level", _C)
def level_totals(spark, d):
    return T.files(spark, d).groupBy("level").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.max("max_txid").alias("reach"))


@_query("latest_per_key", "SELECT l_orderkey, max(l_shipdate) AS l_shipdate, count(*) AS lines FROM lineitem GROUP BY l_orderkey")
def latest_per_key(spark, d):
    return T.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("l_shipdate"), F.count("*").alias("lines"))


@_query("order_overlay", "SELECT o_orderkey AS page_number, CASE WHEN q IS NULL THEN o_totalprice ELSE q END AS payload FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS q FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def order_overlay(spark, d):
    base = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("page_number"), F.col("o_totalprice").alias("payload"))
    top = T.read(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    delta = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_number")).agg(F.max("l_extendedprice").alias("payload"))
    return merge.apply_overlay(base, delta, top, ["payload"])


from pagelog.plans import binary  # noqa: E402, F401  (registers its queries here)
