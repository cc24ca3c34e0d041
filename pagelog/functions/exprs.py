"""Scalar surface as Column expressions; all of them stay inside whole-stage code generation.

Transaction ids are unsigned 64-bit numbers: DECIMAL(20,0) where they may exceed 2^63-1, BIGINT otherwise. Checksums are
BIGINT bit patterns; their highest bit is a flag that must be set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the file format.
FLAG = -(1 << 63)  # the highest bit, as BIGINT
LOCK_BYTE = 0x40000000
NO_CHECKSUM = 2
PAGE_SIZES = (512, 65536)
SNAPSHOT_LEVEL = 9
MAX_TXID = (1 << 64) - 1
WAL_HEADER, FRAME_HEADER = 32, 24

_TXID = "decimal(20,0)"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def valid_page_size(n) -> Column:
    n = _c(n)
    return n.between(*PAGE_SIZES) & (n.bitwiseAND(n - 1) == 0)


def lock_page(page_size) -> Column:
    """The page that no file carries."""
    return F.floor(F.lit(LOCK_BYTE) / _c(page_size)).cast("bigint") + 1


def is_snapshot(min_txid="min_txid") -> Column:
    return _c(min_txid) == 1


def no_checksum(flags="flags") -> Column:
    return _c(flags).bitwiseAND(NO_CHECKSUM) != 0


def pre_position(min_txid="min_txid", checksum="pre_apply_checksum") -> Column:
    return F.struct((_c(min_txid) - 1).alias("txid"), _c(checksum).alias("post_apply_checksum"))


def post_position(max_txid="max_txid", checksum="post_apply_checksum") -> Column:
    return F.struct(_c(max_txid).alias("txid"), _c(checksum).alias("post_apply_checksum"))


def rolling_add(acc, page_checksum) -> Column:
    """Both sides must carry the flag; xor drops it and it is set again."""
    a, b = _c(acc), _c(page_checksum)
    bad = (a >= 0) | (b >= 0)
    return F.when(bad, F.raise_error(F.lit("InvalidChecksumFormat")).cast("bigint")).otherwise(a.bitwiseXOR(b).bitwiseOR(F.lit(FLAG)))


def rolling_replace(acc, old, new) -> Column:
    """A database checksum after one page's checksum ``old`` became ``new``; null stands for no page."""
    zero = F.lit(0).cast("bigint")
    return _c(acc).bitwiseXOR(F.coalesce(_c(old), zero)).bitwiseXOR(F.coalesce(_c(new), zero)).bitwiseOR(F.lit(FLAG))


def checksum_fold(page_checksum) -> Column:
    """Aggregate: the database checksum of page checksums, in any order. An empty database has the flag alone."""
    body = F.bit_xor(_c(page_checksum).bitwiseAND(F.lit((1 << 63) - 1)))
    return F.coalesce(body, F.lit(0).cast("bigint")).bitwiseOR(F.lit(FLAG))


def format_txid(txid) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.conv(_c(txid).cast(_TXID).cast("string"), 10, 16)), 16, "0")


def parse_txid(text) -> Column:
    """DECIMAL(20,0), null unless exactly 16 hex digits of either case."""
    t = _c(text)
    return F.when(t.rlike("^[0-9a-fA-F]{16}$"), F.conv(t, 16, 10).cast(_TXID))


def file_name(min_txid, max_txid) -> Column:
    return F.concat(format_txid(min_txid), F.lit("-"), format_txid(max_txid), F.lit(".ltx"))


def parse_file_name(name) -> Column:
    """STRUCT<min_txid, max_txid>, null for names of another form, zero ids or a reversed range."""
    n = _c(name)
    lo, hi = parse_txid(F.substring(n, 1, 16)), parse_txid(F.substring(n, 18, 16))
    fits = n.rlike(r"^[0-9a-fA-F]{16}-[0-9a-fA-F]{16}\.ltx$") & (lo > 0) & (lo <= hi)
    return F.when(fits, F.struct(lo.alias("min_txid"), hi.alias("max_txid")))


def level_dir(level, hex4: bool = False) -> Column:
    """A decimal digit on file systems, four hex digits in object stores; null above the snapshot level."""
    n = _c(level)
    text = F.lpad(F.lower(F.hex(n)), 4, "0") if hex4 else n.cast("string")
    return F.when(n.between(0, SNAPSHOT_LEVEL), text)


def file_path(root: str, level, min_txid, max_txid) -> Column:
    parts = [F.lit(root)] if root else []
    return F.concat_ws("/", *parts, F.lit("ltx"), level_dir(level), file_name(min_txid, max_txid))


def object_key(prefix: str, level, min_txid, max_txid) -> Column:
    """Absolute, percent-encoded key."""
    from urllib.parse import quote

    head = f"/{quote(prefix.strip('/'), safe='/-_.~')}/" if prefix.strip("/") else "/"
    return F.concat(F.lit(head), level_dir(level, hex4=True), F.lit("/"), file_name(min_txid, max_txid))


def literal_bound(n) -> Column:
    """Bytes of one LZ4 block that holds n bytes as literals only."""
    n = _c(n)
    return (F.when(n < 15, 1).otherwise(2 + F.floor((n - 15) / 255)) + n).cast("bigint")


def compress_bound(n) -> Column:
    n = _c(n)
    return (n + F.floor(n / 255) + 16).cast("bigint")


def database_size(commit, page_size) -> Column:
    return _c(commit).cast("bigint") * _c(page_size).cast("bigint")


def page_offset(page_number, page_size) -> Column:
    return (_c(page_number).cast("bigint") - 1) * _c(page_size).cast("bigint")


def interval_start(now_ms, interval_ms) -> Column:
    """The last epoch-aligned boundary at or before now; interval 0: now itself."""
    now, i = _c(now_ms), _c(interval_ms)
    return F.when(i == 0, now).otherwise(now - now % F.when(i == 0, 1).otherwise(i))


def interval_next(now_ms, interval_ms) -> Column:
    return interval_start(now_ms, interval_ms) + _c(interval_ms)


def elapsed_ms(now_ms, since_ms) -> Column:
    now, since = _c(now_ms), _c(since_ms)
    return F.when(now < since, F.raise_error(F.lit("TimestampRegression")).cast("bigint")).otherwise(now - since)


def committed_frames(end_offset, page_size) -> Column:
    """Frames before an end offset; null unless it is a frame boundary."""
    body, frame = _c(end_offset) - WAL_HEADER, _c(page_size) + FRAME_HEADER
    return F.when((body >= 0) & (body % frame == 0), F.floor(body / frame).cast("bigint"))


def next_txid(txid) -> Column:
    t = _c(txid).cast(_TXID)
    return F.when(t < F.lit(str(MAX_TXID)).cast(_TXID), (t + 1).cast(_TXID))


def timestamp_text(ms) -> Column:
    """RFC 3339 in UTC with trailing zeros of the milliseconds trimmed."""
    t = F.timestamp_millis(_c(ms))
    text = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""), F.lit("Z"))


def wire_bound(pages, compressed, index_bytes) -> Column:
    """Bytes that an encoded file can have at most: 122 + N(10 + C) + index."""
    return F.lit(122) + _c(pages) * (10 + _c(compressed)) + _c(index_bytes)
