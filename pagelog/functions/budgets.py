"""Size bounds and request rules as Column expressions, for cost estimates over catalogs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelog.functions import exprs
from pagelog.functions.exprs import _c

#: Fixed sizes of the file format: header, terminator, index size, index terminator, trailer; page header with size prefix.
FIXED, FRAME, VARINT = 100 + 6 + 16, 10, 10


def configured_bound(pages, compressed, index_bytes) -> Column:
    """Bytes of a file of so many pages under configured page and index limits."""
    return F.lit(FIXED) + _c(pages) * (FRAME + _c(compressed)) + _c(index_bytes)


def coarse_bound(pages, compressed) -> Column:
    """The same with three longest varints a page, the index terminator and the index size."""
    return F.lit(FIXED + 9) + _c(pages) * (FRAME + _c(compressed) + 3 * VARINT)


def decode_events(max_pages) -> Column:
    """Steps of one whole decode at most: header, pages, end of pages, verdict."""
    return _c(max_pages).cast("bigint") + 3


def scan_reads(checked, commit, page_size) -> Column:
    """Pages that proving an image reads: none without checksums, and never the lock page."""
    reads = _c(commit) - F.when(exprs.lock_page(page_size) <= _c(commit), 1).otherwise(0)
    return F.when(_c(checked), reads.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def read_windows(window_bytes, inputs) -> Column:
    """Bytes of read windows for a compaction's inputs and one restore."""
    return _c(window_bytes).cast("bigint") * (_c(inputs) + 1)


def transient(status, code: Column | None = None) -> Column:
    """Whether a store's answer may pass if asked again."""
    lasting = F.lit("") if code is None else code
    return _c(status).isin(500, 502, 503, 504, 429, 408) | ((_c(status) == 400) & lasting.isin("RequestTimeout", "IncompleteBody"))


def may_send_again(method, indeterminate, same_bytes, conditional, orphan_only, status) -> Column:
    """Whether a request that was sent may be sent again; status 0: no answer came."""
    s = _c(status)
    published = _c(same_bytes) | (_c(conditional) & (s >= 400) & (s < 500))
    plain = _c(method).isin("GET", "HEAD", "DELETE", "PUT") | ((_c(method) == "POST") & _c(orphan_only))
    return F.when(_c(indeterminate), published).otherwise(plain)


def upload_etag(etags) -> Column:
    """Quoted MD5 of the parts' MD5s with the part count, from an array of their etags; null if one is no MD5."""
    bare = F.transform(_c(etags), lambda e: F.regexp_replace(e, '^"+|"+$', ""))
    fits = F.forall(bare, lambda e: e.rlike("^[0-9a-fA-F]{32}$"))
    return F.when(fits, F.concat(F.lit('"'), F.md5(F.unhex(F.array_join(bare, ""))), F.lit("-"), F.size(bare).cast("string"), F.lit('"')))


def image_fault(first, size_bytes, page_size) -> Column:
    """What is wrong with a database file, from its first 100 bytes, size and expected page size; null if nothing is."""
    h, n, p = _c(first), _c(size_bytes).cast("bigint"), _c(page_size).cast("bigint")
    num = lambda at, k: F.conv(F.hex(F.substring(h, at + 1, k)), 16, 10).cast("bigint")
    size = F.when(num(16, 2) == 1, F.lit(65536)).otherwise(num(16, 2))
    magic = F.substring(h, 1, 16) == F.lit(b"SQLite format 3\0")
    versions = num(18, 1).isin(1, 2) & num(19, 1).isin(1, 2) & (num(21, 1) == 64) & (num(22, 1) == 32) & (num(23, 1) == 32)
    count, known = num(28, 4), num(24, 4) == num(92, 4)
    return (
        F.when(n == 0, None).when((n < 100) | (n % p != 0) | (F.octet_length(h) < 100) | ~magic, "InvalidSQLiteDatabase").when(size != p, "DatabasePageSizeMismatch")
        .when(~versions | (p - num(20, 1) < 480), "InvalidSQLiteDatabase").when((count != 0) & known & (count * p != n), "InvalidSQLiteDatabase")
    )
