"""Constraint checks as verdict rows: what fails, with the first error in the order a reader would meet it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelog.functions import exprs


def headers(rows: DataFrame, max_page_size: int = 65536, max_span: int = (1 << 63) - 1, max_pages: int = (1 << 32) - 1, max_index: int = (1 << 32) - 1) -> DataFrame:
    """Header rows that break a rule, with ``fault``."""
    c = F.col
    lock = exprs.lock_page(c("page_size"))
    needed = c("commit") - F.when(lock <= c("commit"), 1).otherwise(0)
    plain = exprs.no_checksum()
    snap = exprs.is_snapshot()
    salted = (c("wal_salt_1") != 0) | (c("wal_salt_2") != 0) | (c("wal_size") != 0)
    fault = (
        F.when(c("flags").bitwiseAND(~exprs.NO_CHECKSUM) != 0, "InvalidHeaderFlags")
        .when(~exprs.valid_page_size("page_size"), "InvalidPageSize")
        .when(c("page_size") > max_page_size, "PageSizeLimitExceeded")
        .when((c("min_txid") == 0) | (c("max_txid") == 0) | (c("min_txid") > c("max_txid")), "InvalidTXIDRange")
        .when(c("max_txid") - c("min_txid") >= max_span, "TransactionSpanLimitExceeded")
        .when((c("wal_offset") < 0) | (c("wal_size") < 0) | (salted & (c("wal_offset") == 0)), "InvalidWALMetadata")
        .when((snap | plain) & (c("pre_apply_checksum") != 0), "InvalidPreApplyChecksum")
        .when(~snap & ~plain & (c("pre_apply_checksum") >= 0), "InvalidPreApplyChecksum")
        .when(snap & (needed > max_pages), "PageLimitExceeded")
        .when(snap & (needed > max_index), "PageIndexLimitExceeded")
    )
    return rows.withColumn("fault", fault).where("fault is not null")


def trailers(rows: DataFrame) -> DataFrame:
    """Trailer rows (with their header's flags and commit) that break a rule, with ``fault``."""
    c = F.col
    plain = exprs.no_checksum()
    fault = (
        F.when(plain & (c("post_apply_checksum") != 0), "InvalidTrailer")
        .when(~plain & (c("post_apply_checksum") >= 0), "InvalidChecksumFormat")
        .when(~plain & (c("commit") == 0) & (c("post_apply_checksum") != F.lit(exprs.FLAG)), "InvalidTrailer")
        .when(c("file_checksum") >= 0, "InvalidChecksumFormat")
    )
    return rows.withColumn("fault", fault).where("fault is not null")


def pages(rows: DataFrame) -> DataFrame:
    """Page rows (with their header's page_size and commit) that break a rule on their own, with ``fault``."""
    c = F.col
    fault = (
        F.when(c("page_number") == 0, "InvalidPageNumber").when(c("flags").bitwiseAND(~1) != 0, "InvalidPageFlags")
        .when(c("page_number") > c("commit"), "InvalidPageNumber").when(c("page_number") == exprs.lock_page("page_size"), "LockPagePresent")
    )
    return rows.withColumn("fault", fault).where("fault is not null")


def page_order(rows: DataFrame, file: str = "path", order: str = "frame_offset_bytes") -> DataFrame:
    """Pages whose number is not above the one before in the same file."""
    w = Window.partitionBy(file).orderBy(order)
    return rows.withColumn("__before", F.lag("page_number").over(w)).where(F.col("page_number") <= F.col("__before")).drop("__before")


def snapshot_completeness(heads: DataFrame, page_rows: DataFrame, key: str = "input_ordinal") -> DataFrame:
    """(key, page_count, last_page, complete): whether an input holds pages 1..commit but the lock page."""
    got = page_rows.groupBy(key).agg(F.count("*").alias("page_count"), F.max("page_number").alias("last_page"))
    lock = exprs.lock_page("page_size")
    want = F.col("commit") - F.when(lock <= F.col("commit"), 1).otherwise(0)
    last = F.when(lock == F.col("commit"), F.col("commit") - 1).otherwise(F.col("commit"))
    count = F.coalesce("page_count", F.lit(0))
    return heads.join(got, key, "left").select(key, count.alias("page_count"), "last_page", ((count == want) & (F.coalesce("last_page", F.lit(0)) == last)).alias("complete"))


def identity_mismatch(heads: DataFrame, names: DataFrame, key: str = "path") -> DataFrame:
    """Files whose name tells another transaction range than their header, or none."""
    parsed = names.select(key, exprs.parse_file_name("name").alias("__id"))
    differs = F.col("__id").isNull() | (F.col("__id.min_txid") != F.col("min_txid")) | (F.col("__id.max_txid") != F.col("max_txid"))
    return heads.join(parsed, key).where(differs).drop("__id")


def compatible(heads: DataFrame, order: str = "input_ordinal") -> str | None:
    """The first reason why inputs cannot be compacted together: page size, then checksum mode, then a gap; else None."""
    sizes, modes, n, first, last = heads.agg(F.count_distinct("page_size"), F.count_distinct(exprs.no_checksum()), F.count("*"), F.min("min_txid"), F.max("max_txid")).first()
    if not n:
        return "CompactionInputRequired"
    if sizes > 1:
        return "CompactionPageSizeMismatch"
    if modes > 1:
        return "CompactionChecksumModeMismatch"
    before = heads.select((F.col("max_txid") + 1).alias("__next"), (F.col(order) + 1).alias(order))
    broken = heads.join(before, order).where(F.col("min_txid") != F.col("__next"))
    return None if broken.isEmpty() else "NonContiguousTransition"


def index_mismatch(index: DataFrame, observed: DataFrame) -> DataFrame:
    """Entries that an index and the frames seen do not share, by position: (path, entry, page, offset, size) on either side."""
    on, cols = ["path", "entry"], ["page_number", "frame_offset_bytes", "frame_size_bytes"]
    a, b = index.select(*on, F.struct(*cols).alias("indexed")), observed.select(*on, F.struct(*cols).alias("observed"))
    return a.join(b, on, "full_outer").where(~F.col("indexed").eqNullSafe(F.col("observed")))


def checkpoint_due(pending: Column, wal_bytes: Column, frames: Column, age_ms: Column, max_bytes: int, max_frames: int, max_age_ms: int) -> Column:
    """Whether a log should be checkpointed; a threshold of 0 is off."""
    due = pending
    for value, most in ((wal_bytes, max_bytes), (frames, max_frames), (age_ms, max_age_ms)):
        if most:
            due = due | (value >= most)
    return due


def clock_regressions(rows: DataFrame, partition: str, order: str, clock: str) -> DataFrame:
    """Rows whose clock runs behind the row before."""
    w = Window.partitionBy(partition).orderBy(order)
    return rows.withColumn("__before", F.lag(clock).over(w)).where(F.col(clock) < F.col("__before")).drop("__before")
