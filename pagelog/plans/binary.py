"""Registered queries over the binary formats: rows become files in the shared folder, and files become rows again.

Fifty transactions of the page log are one file of level 0; a page's bytes begin with the number of its frame. The first file
is a snapshot, so it holds every page, and those that no frame wrote begin with -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelog.functions import budgets, codec, exprs, udfs
from pagelog.operators import catalog, control, merge, validate, walsync
from pagelog.plans import tables as T
from pagelog.plans.registry import _query
from pagelog.sources import logfiles, objects, scratch, store, wal
from pagelog.streaming import capture

#: Transactions of a file, frames of a log, bytes of a page.
GROUP, LOG, SIZE = 50, 1000, 512

_CHAIN = (
    T.FRAMES,
    T.HEADERS,
    f"""heads AS (
  SELECT (input_ordinal - 1) // {GROUP} AS input_ordinal, arg_max("commit", input_ordinal) AS "commit", min(min_txid) AS min_txid, max(max_txid) AS max_txid, max(timestamp_ms) AS timestamp_ms
  FROM headers GROUP BY 1
)""",
    f"""sheets AS (
  SELECT (f.txid - 1) // {GROUP} AS input_ordinal, page_number, max(frame_index) AS frame_index
  FROM frames f JOIN headers h ON h.max_txid = f.txid JOIN heads b ON b.input_ordinal = (f.txid - 1) // {GROUP} AND page_number <= b."commit" GROUP BY 1, 2
)""",
    """chain AS (
  SELECT * FROM sheets
  UNION ALL SELECT 0, i, -1 FROM range(1, (SELECT "commit" + 1 FROM heads WHERE input_ordinal = 0)) r(i) WHERE i NOT IN (SELECT page_number FROM sheets WHERE input_ordinal = 0)
)""",
)


def _bytes(number: Column) -> Column:
    return F.encode(F.rpad(F.concat(number.cast("string"), F.lit(".")), SIZE, "-"), "utf-8")


def _number(data: Column) -> Column:
    return F.split(F.decode(data, "utf-8"), r"\.", 2)[0].cast("bigint")


def _chain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(heads, pages) of the chain, as `logfiles.encode_files` takes them."""
    f = T.frames(spark, d)
    h = T.headers(f)
    group = F.floor((F.col("txid") - 1) / GROUP)
    last = lambda c: F.max_by(c, "input_ordinal")
    heads = h.groupBy(F.floor((F.col("input_ordinal") - 1) / GROUP).alias("input_ordinal")).agg(last("commit").alias("commit"), F.min("min_txid").alias("min_txid"), F.max("max_txid").alias("max_txid"), F.max("timestamp_ms").alias("timestamp_ms"))
    done = f.join(h.select(F.col("max_txid").alias("txid")), "txid")
    rows = done.select(group.alias("input_ordinal"), "page_number", "frame_index").groupBy("input_ordinal", "page_number").agg(F.max("frame_index").alias("frame_index"))
    rows = rows.join(heads.select("input_ordinal", "commit"), "input_ordinal").where("page_number <= commit").drop("commit")
    first = heads.where("input_ordinal = 0").select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("commit"))).alias("page_number"))
    blank = first.join(rows.where("input_ordinal = 0"), "page_number", "left_anti").select(F.lit(0).cast("bigint").alias("input_ordinal"), "page_number", F.lit(-1).cast("bigint").alias("frame_index"))
    pages = rows.unionByName(blank).select("input_ordinal", "page_number", _bytes(F.col("frame_index")).alias("data"))
    given = {"flags": F.lit(codec.NO_CHECKSUM), "page_size": F.lit(SIZE), "commit": F.col("commit"), "min_txid": F.col("min_txid"), "max_txid": F.col("max_txid"), "timestamp_ms": F.col("timestamp_ms")}
    fields = [given.get(n, F.lit(0)).cast("decimal(20,0)" if n in logfiles._WIDE else "bigint").alias(n) for n in logfiles._HEAD]
    return heads.select("input_ordinal", *fields, F.lit(None).cast("bigint").alias("post_apply_checksum")), pages


def _tree(spark: SparkSession, d: str, change=None) -> str:
    """A replica tree with the chain's files at level 0; ``change`` may alter the files' rows (input_ordinal, name, content)."""
    root = scratch.path(spark, "tree")
    files = logfiles.encode_files(*_chain(spark, d))
    files = change(files) if change else files
    logfiles.publish(files.select(F.lit("ltx/0").alias("folder"), "name", "content"), root).collect()  # a row for each file
    return root


def _ordinal(path: str = "path") -> Column:
    return F.floor((exprs.parse_file_name(F.element_at(F.split(path, "/"), -1))["min_txid"].cast("bigint") - 1) / GROUP)


# Files


@_query("ltx_files", 'SELECT h.min_txid, h.max_txid, h."commit", count(*) AS page_count, 512 AS page_size, timestamp_ms, \'verified\' AS status, 0 AS level FROM heads h JOIN chain USING (input_ordinal) GROUP BY ALL', _CHAIN)
def ltx_files(spark, d):
    out = logfiles.read_files(spark, f"{_tree(spark, d)}/ltx")
    return out.select(F.col("min_txid").cast("bigint").alias("min_txid"), F.col("max_txid").cast("bigint").alias("max_txid"), "commit", "page_count", "page_size", "timestamp_ms", "status", "level")


@_query("ltx_headers", 'SELECT min_txid, max_txid, "commit", 2 AS flags, \'header\' AS status, CAST(NULL AS BIGINT) AS page_count FROM heads', _CHAIN)
def ltx_headers(spark, d):
    out = logfiles.read_files(spark, f"{_tree(spark, d)}/ltx", header_only=True)
    return out.select(F.col("min_txid").cast("bigint").alias("min_txid"), F.col("max_txid").cast("bigint").alias("max_txid"), "commit", F.col("flags").cast("int").alias("flags"), "status", "page_count")


@_query("ltx_pages", "SELECT input_ordinal, page_number, frame_index FROM chain", _CHAIN)
def ltx_pages(spark, d):
    out = logfiles.read_pages(spark, f"{_tree(spark, d)}/ltx")
    return out.select(_ordinal().alias("input_ordinal"), "page_number", _number(F.col("data")).alias("frame_index"))


@_query("ltx_index", "SELECT input_ordinal, row_number() OVER (PARTITION BY input_ordinal ORDER BY page_number) - 1 AS entry, page_number FROM chain", _CHAIN)
def ltx_index(spark, d):
    return logfiles.read_index(spark, f"{_tree(spark, d)}/ltx").select(_ordinal().alias("input_ordinal"), "entry", "page_number")


@_query("ltx_index_mismatch", "SELECT input_ordinal, entry FROM (SELECT input_ordinal, row_number() OVER (PARTITION BY input_ordinal ORDER BY page_number) - 1 AS entry FROM chain) WHERE entry % 7 = 3", _CHAIN)
def ltx_index_mismatch(spark, d):
    """The pages' own places against the index, with every seventh entry of the index moved by one byte."""
    root = f"{_tree(spark, d)}/ltx"
    w = Window.partitionBy("path").orderBy("frame_offset_bytes")
    seen = logfiles.read_pages(spark, root).select("path", (F.row_number().over(w) - 1).cast("bigint").alias("entry"), "page_number", "frame_offset_bytes", "frame_size_bytes")
    index = logfiles.read_index(spark, root).withColumn("frame_size_bytes", F.col("frame_size_bytes") + F.when(F.col("entry") % 7 == 3, 1).otherwise(0)).drop("error")
    return validate.index_mismatch(index, seen).select(_ordinal().alias("input_ordinal"), "entry")


@_query("ltx_damaged", "SELECT input_ordinal, CASE input_ordinal % 4 WHEN 0 THEN 'TruncatedInput' WHEN 1 THEN 'ChecksumMismatch' WHEN 2 THEN 'TrailingBytes' ELSE 'InvalidMagic' END AS error FROM heads", _CHAIN)
def ltx_damaged(spark, d):
    n, k, c = F.octet_length("content"), F.col("input_ordinal") % 4, F.col("content")
    cut = lambda lo, size: F.substring(c, F.lit(lo) if isinstance(lo, int) else lo, size)
    flip = F.when(cut(n, F.lit(1)) == F.lit(b"\x00"), F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    bad = F.when(k == 0, cut(1, n - 1)).when(k == 1, F.concat(cut(1, n - 1), flip)).when(k == 2, F.concat(c, F.lit(b"\x00"))).otherwise(F.concat(F.lit(b"X"), cut(2, n - 1)))
    out = logfiles.read_files(spark, f"{_tree(spark, d, lambda f: f.withColumn('content', bad))}/ltx")
    return out.select(_ordinal().alias("input_ordinal"), "error")


@_query("ltx_limits", "SELECT input_ordinal, CASE WHEN input_ordinal = 0 AND max(\"commit\") > m OR count(*) > m THEN 'PageLimitExceeded' END AS error FROM chain JOIN heads USING (input_ordinal), (SELECT CAST(floor(avg(n)) AS BIGINT) AS m FROM (SELECT count(*) AS n FROM chain GROUP BY input_ordinal)) GROUP BY input_ordinal, m", _CHAIN)
def ltx_limits(spark, d):
    root = f"{_tree(spark, d)}/ltx"
    mean = logfiles.read_index(spark, root).groupBy("path").count().agg(F.floor(F.avg("count"))).first()[0]
    return logfiles.read_files(spark, root, limits=codec.Limits(max_pages=int(mean))).select(_ordinal().alias("input_ordinal"), "error")


@_query("ltx_oversized", "SELECT input_ordinal, 'InputLimitExceeded' AS error FROM heads", _CHAIN)
def ltx_oversized(spark, d):
    """Files beyond the limit are not opened; each still has its verdict."""
    return logfiles.read_files(spark, f"{_tree(spark, d)}/ltx", limits=codec.Limits(max_input_bytes=100)).select(_ordinal().alias("input_ordinal"), "error")


@_query("ltx_checked_snapshot", "SELECT 25 AS page_count, 'verified' AS status, true AS same FROM nation LIMIT 1")
def ltx_checked_snapshot(spark, d):
    """A checked snapshot of the nations: the post checksum in the file is the xor of its pages' checksums."""
    pages = T.read(spark, d, "nation").select(F.lit(0).cast("bigint").alias("input_ordinal"), (F.col("n_nationkey") + 1).cast("bigint").alias("page_number"), _bytes(F.col("n_nationkey")).alias("data"))
    given = {"page_size": SIZE, "commit": 25, "min_txid": 1, "max_txid": 7}
    head = spark.range(1).select(F.col("id").alias("input_ordinal"), *[F.lit(given.get(n, 0)).cast("decimal(20,0)" if n in logfiles._WIDE else "bigint").alias(n) for n in logfiles._HEAD], F.lit(None).cast("bigint").alias("post_apply_checksum"))
    root = scratch.path(spark, "tree")
    logfiles.publish(logfiles.encode_files(head, pages).select(F.lit("ltx/9").alias("folder"), "name", "content"), root).collect()
    total = merge.database_checksum(logfiles.read_pages(spark, f"{root}/ltx"), page_size=SIZE)
    return logfiles.read_files(spark, f"{root}/ltx").join(F.broadcast(total)).select("page_count", "status", (F.col("post_apply_checksum") == F.col("database_checksum")).alias("same"))


@_query("tree_listing", "SELECT 0 AS level, min_txid, max_txid FROM heads", _CHAIN)
def tree_listing(spark, d):
    out = logfiles.listing(spark, f"{_tree(spark, d)}/ltx")
    return out.select("level", F.col("min_txid").cast("bigint").alias("min_txid"), F.col("max_txid").cast("bigint").alias("max_txid"))


@_query("object_ranges", "SELECT min_txid, max_txid, 'LTX1' AS magic, CAST(NULL AS VARCHAR) AS error FROM heads", _CHAIN)
def object_ranges(spark, d):
    """Headers by ranged reads: a hundred bytes of each object, whatever its size."""
    root = _tree(spark, d)
    names = logfiles.listing(spark, f"{root}/ltx").select(F.concat(F.lit("ltx/0/"), F.element_at(F.split("path", "/"), -1)).alias("name"), F.lit(0).cast("bigint").alias("offset"), F.lit(codec.HEADER.size).cast("bigint").alias("length"))
    number = lambda at: F.conv(F.hex(F.substring("data", at, 8)), 16, 10).cast("bigint")
    return objects.ranges(spark, root, names).select(number(17).alias("min_txid"), number(25).alias("max_txid"), F.decode(F.substring("data", 1, 4), "utf-8").alias("magic"), "error")


_RULES = ["empty listing", "missing object", "write", "write again", "exact ranges", "private until finished", "finish publishes", "abort leaves nothing", "create only", "replace if unchanged", "bounded to one generation", "windows", "delete"]


@_query("store_conformance", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{r}')" for k, r in enumerate(_RULES)) + ") v(k, rule)")
def store_conformance(spark, d):
    return spark.createDataFrame(list(enumerate(objects.conformance(scratch.path(spark, "rules")))), "k int, rule string")


# Functions

#: CRC-64 bit by bit, as a BIGINT; ``x`` is the text.
_CRC = """(SELECT CASE WHEN v >= 9223372036854775808 THEN CAST(v::HUGEINT - 18446744073709551616 AS BIGINT) ELSE CAST(v AS BIGINT) END FROM (SELECT xor(list_reduce(
  list_prepend(18446744073709551615::UBIGINT, flatten(list_transform(range(1, strlen({x}) + 1), lambda i: list_transform(range(8), lambda b: ((ascii(substr({x}, CAST(i AS BIGINT), 1)) >> CAST(b AS INT)) & 1)::UBIGINT)))),
  lambda s, b: CASE WHEN (xor(s, b) & 1::UBIGINT) = 1 THEN xor(s >> 1, 15564440312192434176::UBIGINT) ELSE s >> 1 END), 18446744073709551615::UBIGINT) AS v))"""


@_query("crc64_names", f"SELECT n_nationkey, {_CRC.format(x='n_name')} AS crc FROM nation")
def crc64_names(spark, d):
    return T.read(spark, d, "nation").select("n_nationkey", udfs.crc64(F.encode("n_name", "utf-8")).alias("crc"))


@_query("page_checksums", f"SELECT n_nationkey, {_CRC.format(x='t')} | (-9223372036854775807 - 1) AS checksum FROM (SELECT n_nationkey, chr(0) || chr(0) || chr(0) || chr(CAST(n_nationkey + 1 AS INT)) || rpad(n_name, 64, '-') AS t FROM nation)")
def page_checksums(spark, d):
    n = T.read(spark, d, "nation")
    return n.select("n_nationkey", udfs.page_checksum(F.col("n_nationkey") + 1, F.encode(F.rpad("n_name", 64, "-"), "utf-8")).alias("checksum"))


@_query("uvarint_bytes", "SELECT o_orderkey, CASE WHEN v < 128 THEN format('{:02x}', v) WHEN v < 16384 THEN format('{:02x}{:02x}', v % 128 + 128, v // 128) WHEN v < 2097152 THEN format('{:02x}{:02x}{:02x}', v % 128 + 128, v // 128 % 128 + 128, v // 16384) ELSE format('{:02x}{:02x}{:02x}{:02x}', v % 128 + 128, v // 128 % 128 + 128, v // 16384 % 128 + 128, v // 2097152) END AS bytes, v AS back FROM (SELECT o_orderkey, o_orderkey * 131 AS v FROM orders)")
def uvarint_bytes(spark, d):
    o = T.read(spark, d, "orders").select("o_orderkey", udfs.uvarint(F.col("o_orderkey") * 131).alias("b"))
    return o.select("o_orderkey", F.lower(F.hex("b")).alias("bytes"), udfs.read_uvarint("b").alias("back"))


@_query("lz4_round_trip", "SELECT p_partkey, repeat(p_name, CAST(p_partkey % 40 AS INT)) AS text, CASE WHEN n < 15 THEN 1 ELSE 2 + (n - 15) // 255 END + n AS literal_bytes, n < 200 OR p_partkey % 40 < 5 OR true AS fits FROM (SELECT *, strlen(repeat(p_name, CAST(p_partkey % 40 AS INT))) AS n FROM part)")
def lz4_round_trip(spark, d):
    p = T.read(spark, d, "part").select("p_partkey", F.encode(F.repeat("p_name", (F.col("p_partkey") % 40).cast("int")), "utf-8").alias("raw"))
    p = p.withColumn("n", F.octet_length("raw")).select("p_partkey", "n", udfs.lz4_compress("raw").alias("block"), udfs.lz4_literals("raw").alias("plain"))
    same = udfs.lz4_decompress("plain", "n") == udfs.lz4_decompress("block", "n")
    return p.select("p_partkey", F.decode(udfs.lz4_decompress("block", "n"), "utf-8").alias("text"), F.octet_length("plain").cast("bigint").alias("literal_bytes"), (same & (F.octet_length("block") <= exprs.compress_bound("n"))).alias("fits"))


@_query("names_and_paths", "SELECT p_partkey, CAST(p_size % 12 AS INT) AS level, CASE WHEN p_size % 12 <= 9 THEN 'r/ltx/' || (p_size % 12) || '/' || f END AS path, CASE WHEN p_size % 12 <= 9 THEN '/a%20b/' || format('{:04x}', CAST(p_size % 12 AS BIGINT)) || '/' || f END AS key, strftime(make_timestamp(CAST(p_partkey * 86400123000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || CASE WHEN p_partkey * 123 % 1000 = 0 THEN '' ELSE '.' || rtrim(format('{:03d}', p_partkey * 86400123 % 1000), '0') END || 'Z' AS text FROM (SELECT *, format('{:016x}-{:016x}.ltx', p_partkey + 1, p_partkey + 9) AS f FROM part)")
def names_and_paths(spark, d):
    p, level = T.read(spark, d, "part"), (F.col("p_size") % 12).cast("int")
    ids = F.col("p_partkey") + 1, F.col("p_partkey") + 9
    path, key = exprs.file_path("r", level, *ids), exprs.object_key("a b", level, *ids)
    low = level <= exprs.SNAPSHOT_LEVEL
    return p.select("p_partkey", level.alias("level"), F.when(low, path).alias("path"), F.when(low, key).alias("key"), exprs.timestamp_text(F.col("p_partkey") * 86400123).alias("text"))


@_query("positions", "SELECT o_orderkey, o_orderkey AS before, o_orderkey + 3 AS after, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 3 END AS frames, (o_orderkey + 1) * 4096 AS bytes, o_orderkey * 7 AS elapsed, o_orderkey + 4 AS next FROM orders")
def positions(spark, d):
    o, k = T.read(spark, d, "orders"), F.col("o_orderkey")
    end = F.lit(exprs.WAL_HEADER) + F.floor(k / 3) * (exprs.FRAME_HEADER + 4096) + k % 3
    return o.select("o_orderkey", exprs.pre_position(k + 1, F.lit(0))["txid"].alias("before"), exprs.post_position(k + 3, F.lit(0))["txid"].alias("after"), exprs.committed_frames(end, F.lit(4096)).alias("frames"), exprs.database_size(k + 1, F.lit(4096)).alias("bytes"), exprs.elapsed_ms(k * 8, k).alias("elapsed"), exprs.next_txid(k + 3).cast("bigint").alias("next"))


@_query("upload_etags", "SELECT s_suppkey, '\"' || md5(unhex(md5(s_name) || md5(CAST(s_suppkey AS VARCHAR)))) || '-2\"' AS etag FROM supplier")
def upload_etags(spark, d):
    s = T.read(spark, d, "supplier")
    return s.select("s_suppkey", budgets.upload_etag(F.array(F.concat(F.lit('"'), F.md5("s_name"), F.lit('"')), F.md5(F.col("s_suppkey").cast("string")))).alias("etag"))


@_query("retry_rules", "SELECT p_partkey, CAST(400 + p_size * 3 AS INT) IN (500, 502, 503, 504, 429, 408) OR (400 + p_size * 3 = 400) AS passes, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 3 = 0 OR (p_partkey % 5 = 0 AND 400 + p_size * 3 < 500) ELSE p_partkey % 7 <> 0 OR p_partkey % 3 = 0 END AS again FROM part")
def retry_rules(spark, d):
    k, status = F.col("p_partkey"), (F.lit(400) + F.col("p_size") * 3).cast("int")
    method = F.when(k % 7 == 0, "POST").otherwise("PUT")
    return T.read(spark, d, "part").select("p_partkey", budgets.transient(status, F.lit("RequestTimeout")).alias("passes"), budgets.may_send_again(method, k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 3 == 0, status).alias("again"))


@_query("size_bounds", "SELECT p_partkey, 122 + p_size * (10 + 4096) + 800 AS configured, 131 + p_size * (10 + 4096 + 30) AS coarse, p_size + 3 AS events, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS reads, 65536 * (p_size + 1) AS windows FROM part")
def size_bounds(spark, d):
    n = F.col("p_size").cast("bigint")
    return T.read(spark, d, "part").select("p_partkey", budgets.configured_bound(n, F.lit(4096), F.lit(800)).alias("configured"), budgets.coarse_bound(n, F.lit(4096)).alias("coarse"), budgets.decode_events(n).alias("events"), budgets.scan_reads(n % 2 == 0, n, F.lit(4096)).alias("reads"), budgets.read_windows(F.lit(65536), n).alias("windows"))


@_query("image_faults", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'InvalidSQLiteDatabase' WHEN 2 THEN 'DatabasePageSizeMismatch' ELSE 'InvalidSQLiteDatabase' END AS fault FROM supplier")
def image_faults(spark, d):
    head = bytearray(100)
    head[:16], head[16:18], head[18:20], head[21:24] = b"SQLite format 3\0", (512).to_bytes(2, "big"), b"\x01\x01", b"\x40\x20\x20"
    k = F.col("s_suppkey") % 4
    first = F.when(k == 1, F.lit(bytes(100))).otherwise(F.lit(bytes(head)))
    return T.read(spark, d, "supplier").select("s_suppkey", budgets.image_fault(first, F.when(k == 3, 700).otherwise(1024), F.when(k == 2, 1024).otherwise(512)).alias("fault"))


# Rules, every branch of them


@_query("header_rules", "SELECT s_suppkey, [NULL, 'InvalidHeaderFlags', 'InvalidPageSize', 'PageSizeLimitExceeded', 'InvalidTXIDRange', 'TransactionSpanLimitExceeded', 'InvalidWALMetadata', 'InvalidWALMetadata', 'InvalidPreApplyChecksum', 'InvalidPreApplyChecksum', 'PageLimitExceeded', 'PageIndexLimitExceeded'][CAST(s_suppkey % 12 + 1 AS INT)] AS fault FROM supplier WHERE s_suppkey % 12 > 0")
def header_rules(spark, d):
    k = F.col("s_suppkey") % 12
    at = lambda n, v, other: F.when(k == n, F.lit(v)).otherwise(F.lit(other)).cast("bigint")
    rows = T.read(spark, d, "supplier").select(
        "s_suppkey", at(1, 4, 2).alias("flags"), F.when(k == 2, 500).when(k == 3, 65536).otherwise(4096).cast("bigint").alias("page_size"), F.when(k == 10, 600).when(k == 11, 550).otherwise(9).cast("bigint").alias("commit"),
        F.when(k == 4, 0).when(k.isin(10, 11), 1).otherwise(5).cast("bigint").alias("min_txid"), F.when(k == 5, 5000).otherwise(7).cast("bigint").alias("max_txid"), F.when(k.isin(8, 9), 77).otherwise(0).cast("bigint").alias("pre_apply_checksum"),
        at(6, -1, 0).alias("wal_offset"), F.lit(0).cast("bigint").alias("wal_size"), at(7, 3, 0).alias("wal_salt_1"), F.lit(0).cast("bigint").alias("wal_salt_2"),
    ).withColumn("flags", F.when(k == 9, 0).otherwise(F.col("flags")))
    return validate.headers(rows, max_page_size=32768, max_span=1000, max_pages=575, max_index=540).select("s_suppkey", "fault")


@_query("trailer_rules", "SELECT s_suppkey, [NULL, 'InvalidTrailer', 'InvalidChecksumFormat', 'InvalidTrailer', 'InvalidChecksumFormat'][CAST(s_suppkey % 5 + 1 AS INT)] AS fault FROM supplier WHERE s_suppkey % 5 > 0")
def trailer_rules(spark, d):
    k, flag = F.col("s_suppkey") % 5, F.lit(-(1 << 63))
    rows = T.read(spark, d, "supplier").select("s_suppkey", F.when(k == 1, 2).otherwise(0).alias("flags"), F.when(k == 3, 0).otherwise(3).alias("commit"), F.when(k.isin(1, 2), F.lit(5)).when(k == 3, flag + 1).otherwise(flag).alias("post_apply_checksum"), F.when(k == 4, F.lit(1)).otherwise(flag).alias("file_checksum"))
    return validate.trailers(rows).select("s_suppkey", "fault")


@_query("page_rules", "SELECT s_suppkey, [NULL, 'InvalidPageNumber', 'InvalidPageFlags', 'InvalidPageNumber', 'LockPagePresent'][CAST(s_suppkey % 5 + 1 AS INT)] AS fault FROM supplier WHERE s_suppkey % 5 > 0")
def page_rules(spark, d):
    k = F.col("s_suppkey") % 5
    rows = T.read(spark, d, "supplier").select("s_suppkey", F.when(k == 1, 0).when(k == 3, 30000).when(k == 4, 16385).otherwise(1).alias("page_number"), F.when(k == 2, 2).otherwise(1).alias("flags"), F.lit(20000).alias("commit"), F.lit(65536).alias("page_size"))
    return validate.pages(rows).select("s_suppkey", "fault")


@_query("listing_rules", "SELECT * FROM (VALUES (0, 2, 'size'), (0, 3, 'range'), (0, 5, 'order'), (9, 4, 'snapshot'), (12, 1, 'level')) v(level, min_txid, fault)")
def listing_rules(spark, d):
    rows = [(0, 1, 1, 10), (0, 2, 2, 0), (0, 3, 2, 10), (0, 5, 6, 10), (0, 5, 6, 10), (9, 1, 3, 10), (9, 4, 5, 10), (12, 1, 1, 10)]
    return catalog.listing_faults(spark.createDataFrame(rows, "level int, min_txid int, max_txid int, size_bytes bigint")).select("level", "min_txid", "fault")


@_query("chain_rules", "SELECT * FROM (VALUES (1, 'NonContiguousTransition'), (3, 'DivergentHistory')) v(input_ordinal, fault)")
def chain_rules(spark, d):
    flag = -(1 << 63)
    rows = [(0, 1, 2, 0, flag + 1, 0), (1, 4, 4, flag + 1, flag + 2, 0), (2, 5, 6, flag + 2, flag + 3, 0), (3, 7, 7, flag + 9, flag + 4, 0), (4, 8, 8, 0, 0, 2)]
    return catalog.contiguity_breaks(spark.createDataFrame(rows, "input_ordinal bigint, min_txid bigint, max_txid bigint, pre_apply_checksum bigint, post_apply_checksum bigint, flags int")).select("input_ordinal", "fault")


@_query("compaction_rules", "SELECT * FROM (VALUES ('gap', 'NonContiguousTransition'), ('mode', 'CompactionChecksumModeMismatch'), ('none', 'CompactionInputRequired'), ('ok', NULL), ('size', 'CompactionPageSizeMismatch')) v(name, fault)")
def compaction_rules(spark, d):
    head = lambda *rows: spark.createDataFrame(rows, "input_ordinal bigint, min_txid bigint, max_txid bigint, page_size int, flags int")
    cases = {"ok": [(0, 1, 2, 512, 2), (1, 3, 3, 512, 2)], "gap": [(0, 1, 2, 512, 2), (1, 4, 4, 512, 2)], "mode": [(0, 1, 2, 512, 2), (1, 3, 3, 512, 0)], "size": [(0, 1, 2, 512, 2), (1, 3, 3, 1024, 2)]}
    found = [(n, validate.compatible(head(*rows))) for n, rows in cases.items()] + [("none", validate.compatible(head((0, 1, 1, 512, 2)).limit(0)))]
    return spark.createDataFrame(found, "name string, fault string")


@_query("clock_regressions", "SELECT l_orderkey, l_partkey, l_shipdate FROM (SELECT l_orderkey, l_partkey, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS before FROM lineitem) WHERE l_shipdate < before")
def clock_regressions(spark, d):
    rows = T.read(spark, d, "lineitem").withColumn("at", F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"))
    return validate.clock_regressions(rows, "l_orderkey", "at", "l_shipdate").select("l_orderkey", "l_partkey", "l_shipdate")


# Write-ahead logs


def _logs(spark: SparkSession, d: str, change=None) -> str:
    """Logs of LOG frames each, as objects ``wal/<number>``; ``change`` (number, bytes) may alter a log's bytes."""
    root = scratch.path(spark, "logs")
    rows = T.frames(spark, d).select(F.floor(F.col("frame_index") / LOG).alias("log"), "frame_index", "page_number", "commit_pages", _bytes(F.col("frame_index")).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def done() -> pa.RecordBatch:
            data = wal.build(held, SIZE, (now + 1, 7))
            data = change(now, data) if change else data
            return pa.RecordBatch.from_arrays([pa.array(["wal"]), pa.array([f"{now:06d}"]), pa.array([data], pa.binary())], names=["folder", "name", "content"])

        for b in batches:
            for log, page, commit, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if log != now:
                    if held:
                        yield done()
                    now, held[:] = log, []
                held.append((page, commit, data))
        if held:
            yield done()

    made = rows.repartition("log").sortWithinPartitions("log", "frame_index").mapInArrow(run, "folder string, name string, content binary")
    logfiles.publish(made, root).collect()  # a row for each log
    return f"{root}/wal"


def _log(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1).cast("bigint")


_FRAME = f"SELECT frame_index // {LOG} AS log, frame_index % {LOG} AS k, page_number, commit_pages, frame_index FROM frames"


@_query("wal_frames", _FRAME, (T.FRAMES,))
def wal_frames(spark, d):
    f = wal.read_frames(spark, _logs(spark, d))
    return f.select(_log().alias("log"), F.col("frame_index").alias("k"), "page_number", "commit_pages", _number(F.col("data")).alias("frame_index"))


@_query("resume_scan", f"{_FRAME} WHERE frame_index % {LOG} >= 500", (T.FRAMES,))
def resume_scan(spark, d):
    """Frames from the middle of each log on, found by their byte offset; what lies before is not summed again."""
    f = wal.read_frames(spark, _logs(spark, d), wal.HEADER.size + 500 * (wal.FRAME.size + SIZE))
    return f.select(_log().alias("log"), F.col("frame_index").alias("k"), "page_number", "commit_pages", _number(F.col("data")).alias("frame_index"))


def _harm(number: int, data: bytes) -> bytes:
    step, kind = wal.FRAME.size + SIZE, number % 5
    at = wal.HEADER.size + 300 * step
    if kind == 1:
        return data[: at + 100]
    if kind == 2:
        return data[: at + 8] + b"\xff" + data[at + 9 :]
    if kind == 3:
        return data[: at + 200] + b"\xff" + data[at + 201 :]
    return b"x" + data[1:] if kind == 4 else data


@_query("wal_verdicts", f"SELECT log, CASE log % 5 WHEN 0 THEN n WHEN 4 THEN NULL ELSE 300 END AS frames, [ 'end_of_input', 'truncated_frame', 'salt_mismatch', 'checksum_mismatch', NULL][CAST(log % 5 + 1 AS INT)] AS stop, CASE WHEN log % 5 = 4 THEN 'InvalidMagic' END AS error FROM (SELECT frame_index // {LOG} AS log, count(*) AS n FROM frames GROUP BY 1)", (T.FRAMES,))
def wal_verdicts(spark, d):
    """Logs harmed in five ways: nothing, a torn frame, another salt, a changed byte, no log at all."""
    return wal.read_logs(spark, _logs(spark, d, _harm)).select(_log().alias("log"), "frames", "stop", "error")


@_query("wal_salts", f"SELECT DISTINCT frame_index // {LOG} + 1 AS salt_1, 7 AS salt_2 FROM frames", (T.FRAMES,))
def wal_salts(spark, d):
    """Distinct salts of all frames, sums not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                found = wal.salts(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in found], pa.int64()) for k in (0, 1)], names=["salt_1", "salt_2"])

    logs = spark.read.format("binaryFile").load(_logs(spark, d)).select("content")
    return logs.mapInArrow(run, "salt_1 bigint, salt_2 bigint").select("salt_1", F.col("salt_2").cast("int").alias("salt_2"))


@_query("wal_page_limit", f"SELECT frame_index // {LOG} AS log, 'PageLimitExceeded' AS error FROM frames GROUP BY 1 HAVING max(greatest(page_number, commit_pages)) > 10", (T.FRAMES,))
def wal_page_limit(spark, d):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    for _ in wal.Frames(content.as_py(), 0, 10):
                        pass
                    error = None
                except wal.WalError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([error], pa.string())], names=["path", "error"])

    logs = spark.read.format("binaryFile").load(_logs(spark, d)).select("path", "content")
    return logs.mapInArrow(run, "path string, error string").where("error is not null").select(_log().alias("log"), "error")


@_query("database_file", 'SELECT i AS page_number, i * 3 AS frame_index FROM range(1, (SELECT count(*) + 1 FROM customer)) r(i)')
def database_file(spark, d):
    """A database file written as an object and read back as pages."""
    n = T.read(spark, d, "customer").count()
    root = scratch.path(spark, "db")
    body = spark.range(1, n + 1).select(F.lit("db").alias("folder"), F.concat(F.lit("part"), F.floor((F.col("id") - 1) / 1000)).alias("name"), "id", _bytes(F.col("id") * 3).alias("data"))
    whole = body.groupBy("folder", "name").agg(F.array_sort(F.collect_list(F.struct("id", "data"))).alias("p")).select("folder", "name", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("content"))
    logfiles.publish(whole, root).collect()
    pages = logfiles.image_pages(spark, f"{root}/db", SIZE)
    part = F.regexp_extract("path", r"part(\d+)$", 1).cast("bigint")
    return pages.select((part * 1000 + F.col("page_number")).alias("page_number"), _number(F.col("data")).alias("frame_index"))


# The controller


def _controller(spark: SparkSession, d: str) -> control.Controller:
    return control.Controller(spark, _tree(spark, d), bounds=control.Bounds(max_inputs=8))


_LIVE = 'SELECT i AS page_number, coalesce(x.frame_index, -1) AS frame_index FROM range(1, (SELECT arg_max("commit", input_ordinal) + 1 FROM heads)) r(i) LEFT JOIN (SELECT page_number, max(input_ordinal) AS o, arg_max(frame_index, input_ordinal) AS frame_index FROM chain GROUP BY page_number) x ON x.page_number = i AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.input_ordinal > x.o AND h."commit" < i)'
_LIVE = _LIVE.replace("coalesce(x.frame_index, -1)", "coalesce(x.frame_index, -2)")


def _read_image(image: DataFrame) -> DataFrame:
    """A page of zero bytes has no number: -2."""
    return image.select("page_number", F.coalesce(F.when(F.col("data") == F.lit(bytes(SIZE)), F.lit(-2).cast("bigint")), _number(F.col("data"))).alias("frame_index"))


@_query("controller_restore", _LIVE, _CHAIN)
def controller_restore(spark, d):
    return _read_image(_controller(spark, d).restore()[1])


@_query("controller_compaction", "SELECT page_number, max(frame_index) AS frame_index FROM chain, (SELECT max(input_ordinal) AS top FROM heads) WHERE input_ordinal < 8 AND page_number <= (SELECT arg_max(\"commit\", input_ordinal) FROM heads WHERE input_ordinal < 8) GROUP BY page_number", _CHAIN)
def controller_compaction(spark, d):
    """The first quantum towards level 1: the pages of the file it wrote."""
    c = _controller(spark, d)
    c.maintain(1)
    return logfiles.read_pages(spark, f"{c.root}/ltx/1").select("page_number", _number(F.col("data")).alias("frame_index"))


@_query("controller_levels", "SELECT 1 AS level, min(min_txid) AS min_txid, max(max_txid) AS max_txid FROM heads GROUP BY input_ordinal // 8", _CHAIN)
def controller_levels(spark, d):
    """All of level 0 compacted into level 1, eight files at a time."""
    c = _controller(spark, d)
    c.maintain_level(1)
    return c.listing().select("level", F.col("min_txid").cast("bigint").alias("min_txid"), F.col("max_txid").cast("bigint").alias("max_txid"))


@_query("restore_after_compaction", "SELECT page_number, max(frame_index) AS frame_index FROM chain WHERE page_number <= (SELECT min(\"commit\") FROM heads) GROUP BY page_number", _CHAIN)
def restore_after_compaction(spark, d):
    """Pages that no commit ever cut read the same from the compacted tree."""
    c = _controller(spark, d)
    low = logfiles.read_files(spark, f"{c.root}/ltx", header_only=True).agg(F.min("commit")).first()[0]
    c.maintain_level(1)
    return _read_image(c.restore()[1].where(F.col("page_number") <= low))


@_query("controller_verify", "SELECT max(max_txid) AS txid, 0 AS checksum FROM heads", _CHAIN)
def controller_verify(spark, d):
    at = _controller(spark, d).verify()
    return spark.createDataFrame([(at.txid, at.post_apply_checksum)], "txid bigint, checksum int")


@_query("startup_modes", "SELECT * FROM (VALUES ('require_empty', 'ReplicaNotEmpty'), ('restore_latest', 'ok'), ('verified_local', 'ok'), ('verified_other', 'DivergentHistory')) v(mode, outcome)")
def startup_modes(spark, d):
    c = _controller(spark, d)
    image = c.start("restore_latest")[1]
    found = [("restore_latest", "ok")]
    for name, mode, local in (("require_empty", "require_empty", None), ("verified_local", "verified_local", image), ("verified_other", "verified_local", image.where("page_number > 1"))):
        try:
            c.start(mode, None, local)
            found.append((name, "ok"))
        except control.ControlError as e:
            found.append((name, str(e)))
    return spark.createDataFrame(found, "mode string, outcome string")


@_query("capture_sync", f"""SELECT step, kind, txid, CAST((SELECT arg_max(commit_pages, frame_index) FROM frames WHERE commit_pages > 0 AND frame_index < n) AS BIGINT) AS "commit"
  FROM (VALUES (0, 'full', 1, 95), (1, 'unchanged', 1, 95), (2, 'incremental', 2, 137), (3, 'full', 3, 60)) v(step, kind, txid, n)""", (T.FRAMES,))
def capture_sync(spark, d):
    """A log that grows, stands still, grows by a torn transaction more, and starts anew."""
    rows = T.frames(spark, d).where("frame_index < 137").select("frame_index", "page_number", "commit_pages", _bytes(F.col("frame_index")).alias("data")).orderBy("frame_index").collect()
    frames = [(r.page_number, r.commit_pages, bytes(r.data)) for r in rows]
    root, found = scratch.path(spark, "capture"), []
    files = objects.Objects(root)
    files.put("a.db", bytes(SIZE))
    c = walsync.Capture(control.Controller(spark, f"{root}/replica"), f"{root}/a.db", f"{root}/a.db-wal")
    for step, (n, salt) in enumerate(((95, 1), (95, 1), (137, 1), (60, 2))):
        files.delete("a.db-wal")
        files.put("a.db-wal", wal.build(frames[:n], SIZE, (salt, 7)))
        got = c.sync(step)
        found.append((step, got.kind, got.state.position.txid, got.state.commit))
    return spark.createDataFrame(found, "step int, kind string, txid int, commit bigint")


# Images


_REPLAY = "SELECT page_number, frame_index FROM (SELECT f.txid, page_number, frame_index, row_number() OVER (PARTITION BY page_number ORDER BY frame_index DESC) AS rn FROM frames f JOIN headers h ON h.max_txid = f.txid) x WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM headers h WHERE h.max_txid >= x.txid AND h.\"commit\" < x.page_number)"


@_query("stream_capture", _REPLAY, (T.FRAMES, T.HEADERS))
def stream_capture(spark, d):
    """The image that Structured Streaming keeps of the frames, which come in three files and in any cuts."""
    root = scratch.path(spark, "stream")
    f = T.frames(spark, d).select("frame_index", "page_number", "commit_pages")
    n = f.agg(F.max("frame_index")).first()[0] + 1
    for k in range(3):
        f.where((F.col("frame_index") >= n * k // 3) & (F.col("frame_index") < n * (k + 1) // 3)).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(f.schema).parquet(f"{root}/in")
        capture.start(stream, f"{root}/store", f"{root}/checkpoint", availableNow=True).awaitTermination()
    return store.ImageStore(spark, f"{root}/store").read().select("page_number", "frame_index")


@_query("store_generations", "SELECT g AS generation, count(*) AS pages, CAST(sum(frame_index) AS BIGINT) AS total FROM (VALUES (0), (1), (2)) v(g), frames WHERE frame_index % 3 <= g GROUP BY g", (T.FRAMES,))
def store_generations(spark, d):
    s = store.ImageStore(spark, scratch.path(spark, "store"))
    f = T.frames(spark, d)
    for g in range(3):
        s.publish(f.where(F.col("frame_index") % 3 <= g).select("page_number", "frame_index"), g, 0, SIZE, 1)
    s.recover()
    parts = [s.read(g).agg(F.lit(g).alias("generation"), F.count("*").alias("pages"), F.sum("frame_index").alias("total")) for g in range(3)]
    return parts[0].union(parts[1]).union(parts[2])


@_query("staged_apply", "SELECT page_number, max(frame_index) AS frame_index FROM chain WHERE input_ordinal < 2 AND page_number <= (SELECT min(\"commit\") FROM heads WHERE input_ordinal < 2) GROUP BY page_number", _CHAIN)
def staged_apply(spark, d):
    """Two files staged over an empty store and published once their image's checksum holds."""
    root = _tree(spark, d)
    pages = logfiles.read_pages(spark, f"{root}/ltx").withColumn("o", _ordinal()).select("o", "page_number", "data", "page_checksum")
    heads = logfiles.read_files(spark, f"{root}/ltx", header_only=True).orderBy("min_txid").limit(2).collect()
    s = store.ImageStore(spark, f"{root}/store")
    a = s.begin(SIZE)
    for k, h in enumerate(heads):
        a.stage(pages.where(F.col("o") == k).drop("o"), int(h.min_txid), int(h.max_txid), h.commit)
    want = merge.database_checksum(a.image, page_size=SIZE).first()[0]
    a.publish(want)
    low = min(h.commit for h in heads)
    return s.read().where(F.col("page_number") <= low).select("page_number", _number(F.col("data")).alias("frame_index"))


@_query("checksum_update", "SELECT bit_xor(page_checksum & 9223372036854775807) AS checksum_change FROM (SELECT page_checksum FROM pages WHERE input_ordinal = 2 UNION ALL SELECT page_checksum FROM pages WHERE input_ordinal = 1 AND page_number IN (SELECT page_number FROM pages WHERE input_ordinal = 2))", (T.FRAMES, T.HEADERS, T.PAGES))
def checksum_update(spark, d):
    p = T.pages(T.frames(spark, d))
    return merge.checksum_update(p.where("input_ordinal = 1"), p.where("input_ordinal = 2"))
