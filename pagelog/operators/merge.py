"""Merging chains of sparse page updates.

``pages`` are rows (input_ordinal, page_number, ...payload), ``headers`` one row per input (input_ordinal, commit, ...). Page
numbers are the shuffle key throughout; which inputs win is decided on narrow columns, and payloads move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelog.functions import exprs
from pagelog.operators import prefix


def newest_wins(pages: DataFrame, order: str = "input_ordinal", key: str = "page_number") -> DataFrame:
    """Per key, the row of the highest order. Keys and orders alone are aggregated; the winners' payloads are joined in."""
    top = pages.groupBy(key).agg(F.max(order).alias(order))
    return pages.join(top, [key, order])


def final_commit(headers: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """One row (commit): that of the last input."""
    return headers.agg(F.max_by("commit", order).alias("final_commit"))


def truncate(pages: DataFrame, commit: DataFrame, key: str = "page_number") -> DataFrame:
    """Pages at or below a one-row commit."""
    return pages.join(F.broadcast(commit), F.col(key) <= F.col("final_commit")).drop("final_commit")


def compact(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """Newest page per number over all inputs, without those above the last commit. Commits in between play no part."""
    return newest_wins(truncate(pages, final_commit(headers)))


def chain_summary(headers: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """The header of a chain's compaction: first input's start, last input's end, log fields zero."""
    first, last = (lambda c: F.min_by(c, order).alias(c)), (lambda c: F.max_by(c, order).alias(c))
    return headers.agg(first("page_size"), last("commit"), first("min_txid"), last("max_txid"), last("timestamp_ms"), first("pre_apply_checksum"), F.count("*").alias("inputs"))


def least_commit_after(headers: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """(order, least_after): the least commit of all later inputs, null for the last."""
    rows = headers.select(order, "commit", (-F.col(order)).alias("__back"))
    rows = prefix.running(rows, "__back", -F.col("commit"), "__most", how="max", exclusive=True)
    return rows.select(order, (-F.col("__most")).alias("least_after"))


def alive(numbers: DataFrame, least: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """(page_number, order) of the versions that a replay leaves, from narrow rows (page_number, order) of all inputs' pages.

    ``least`` has the least later commit of each input, null for the last; pages above the last commit are still among them.
    """
    newest = numbers.groupBy("page_number").agg(F.max(order).alias(order))
    return newest.join(least, order).where(F.col("least_after").isNull() | (F.col("least_after") >= F.col("page_number"))).select("page_number", order)


def replay(pages: DataFrame, headers: DataFrame, order: str = "input_ordinal") -> DataFrame:
    """Newest page per number under sequential apply: truncation by an earlier commit wipes a page, growth leaves it zero.

    A page's newest version survives if no later input commits below the page's number: an equi-join with one number per
    input. Pages wiped and not written again are not returned (`zero_fill` adds them). A caller that restores from a snapshot
    leaves out the inputs before it.
    """
    left = alive(pages.select("page_number", order), least_commit_after(headers, order), order)
    return truncate(pages.join(left, ["page_number", order]), final_commit(headers, order))


def apply_overlay(base: DataFrame, delta: DataFrame, commit: int | Column, payload: list[str], key: str = "page_number") -> DataFrame:
    """``base`` with ``delta``'s pages over it, cut at ``commit``."""
    b = base.select(key, *[F.col(c).alias(f"__b_{c}") for c in payload])
    d = delta.select(key, *payload, F.lit(True).alias("__new"))
    bound = F.lit(commit) if isinstance(commit, int) else commit
    pick = [F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"__b_{c}")).alias(c) for c in payload]
    return b.join(d, key, "full_outer").where(F.col(key) <= bound).select(key, *pick)


def missing(pages: DataFrame, commit: int, page_size: int, key: str = "page_number") -> DataFrame:
    """(key): pages 1..commit but the lock page that are not among ``pages``."""
    lock = exprs.LOCK_BYTE // page_size + 1
    every = pages.sparkSession.range(1, commit + 1).withColumnRenamed("id", key).where(F.col(key) != lock)
    return every.join(pages.select(key), key, "left_anti")


def zero_fill(pages: DataFrame, commit: int, page_size: int, payload: dict[str, Column], key: str = "page_number", first: int = 1) -> DataFrame:
    """All pages ``first``..commit but the lock page; missing ones get ``payload``'s values."""
    lock = exprs.LOCK_BYTE // page_size + 1
    every = pages.sparkSession.range(first, commit + 1).withColumnRenamed("id", key).where(F.col(key) != lock)
    fill = [F.when(F.col("__have"), F.col(c)).otherwise(v).alias(c) for c, v in payload.items()]
    return every.join(pages.withColumn("__have", F.lit(True)), key, "left").select(key, *fill)


def database_checksum(pages: DataFrame, page_checksum: str = "page_checksum", page_size: int | None = None, key: str = "page_number") -> DataFrame:
    """One row (database_checksum): the xor of all page checksums but the lock page's, partially aggregated in any order."""
    if page_size:
        pages = pages.where(F.col(key) != exprs.LOCK_BYTE // page_size + 1)
    return pages.agg(exprs.checksum_fold(page_checksum).alias("database_checksum"))


def checksum_update(base: DataFrame, delta: DataFrame, page_checksum: str = "page_checksum", key: str = "page_number") -> DataFrame:
    """One row (checksum_change): what a database checksum must be xored with when ``delta``'s pages replace those of ``base``.

    Only the pages of ``delta`` are looked at, so the sum of an image is kept up without reading the image again.
    """
    old = base.join(delta.select(key), key, "left_semi")
    both = old.select(page_checksum).unionAll(delta.select(page_checksum))
    return both.agg(F.coalesce(F.bit_xor(F.col(page_checksum).bitwiseAND(F.lit((1 << 63) - 1))), F.lit(0).cast("bigint")).alias("checksum_change"))


def committed(frames: DataFrame, order: str = "frame_index") -> DataFrame:
    """Frames of committed transactions: those up to the last commit frame."""
    last = frames.agg(F.max(F.when(F.col("commit_pages") > 0, F.col(order))).alias("__last"))
    return frames.join(F.broadcast(last), F.col(order) <= F.col("__last")).drop("__last")


def valid_prefix(frames: DataFrame, bad: Column, order: str = "frame_index") -> DataFrame:
    """Frames before the first bad one."""
    first = frames.agg(F.min(F.when(bad, F.col(order))).alias("__first"))
    return frames.join(F.broadcast(first), F.col("__first").isNull() | (F.col(order) < F.col("__first"))).drop("__first")


def page_map(frames: DataFrame, order: str = "frame_index") -> DataFrame:
    """Per page its newest committed frame, without pages above the final commit: the map of a write-ahead log."""
    done = committed(frames, order)
    commit = done.agg(F.max_by("commit_pages", F.when(F.col("commit_pages") > 0, F.col(order))).alias("final_commit"))
    return newest_wins(truncate(done, commit), order)


def backfill(page_numbers: DataFrame, mapped: DataFrame, database: DataFrame, payload: list[str], key: str = "page_number") -> DataFrame:
    """For each wanted page, the log's version if it has one, else the database file's."""
    m = mapped.select(key, *[F.col(c).alias(f"__m_{c}") for c in payload], F.lit(True).alias("__logged"))
    out = page_numbers.join(m, key, "left").join(database.select(key, *payload), key, "left")
    return out.select(key, *[F.when(F.col("__logged"), F.col(f"__m_{c}")).otherwise(F.col(c)).alias(c) for c in payload])


def captured_pages(mapped: DataFrame, commit: int, previous_end: int, previous_commit: int, page_size: int, order: str = "frame_index") -> DataFrame:
    """(page_number, fresh): pages that an incremental capture must carry: written since, or grown beyond the last commit."""
    lock = exprs.LOCK_BYTE // page_size + 1
    every = mapped.sparkSession.range(1, commit + 1).withColumnRenamed("id", "page_number").where(F.col("page_number") != lock)
    fresh = F.coalesce(F.col(order) >= previous_end, F.lit(False))
    return every.join(mapped.select("page_number", order), "page_number", "left").select("page_number", fresh.alias("fresh")).where(F.col("fresh") | (F.col("page_number") > previous_commit))


def salt_census(frames: DataFrame, salts: list[str], order: str = "frame_index") -> DataFrame:
    """Distinct salts with the frame where each is first seen."""
    return frames.groupBy(*salts).agg(F.min(order).alias("first_frame"))
