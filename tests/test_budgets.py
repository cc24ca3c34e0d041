import hashlib
import sqlite3

from pyspark.sql import functions as F

from pagelog.functions import budgets as B
from pagelog.functions import codec as K


def test_bounds_hold(spark):
    head = K.Header(page_size=512, commit=3)
    data = K.encode(head, [(k, bytes(range(256)) * 2) for k in (1, 2, 3)], compress=False)
    row = spark.range(1).select(B.configured_bound(F.lit(3), F.lit(600), F.lit(64)).alias("a"), B.coarse_bound(F.lit(3), F.lit(600)).alias("b"), B.decode_events(F.lit(3)).alias("c"), B.scan_reads(F.lit(True), F.lit(3), F.lit(512)).alias("d"), B.scan_reads(F.lit(True), F.lit(16385), F.lit(65536)).alias("e"), B.read_windows(F.lit(100), F.lit(4)).alias("f")).first()
    assert len(data) <= row.a and len(data) <= row.b
    assert tuple(row)[2:] == (6, 3, 16384, 500)


def test_requests(spark):
    row = spark.range(1).select(
        B.transient(F.lit(503)).alias("a"), B.transient(F.lit(400), F.lit("IncompleteBody")).alias("b"), B.transient(F.lit(501)).alias("c"),
        B.may_send_again(F.lit("PUT"), F.lit(True), F.lit(False), F.lit(True), F.lit(False), F.lit(429)).alias("d"), B.may_send_again(F.lit("POST"), F.lit(False), F.lit(False), F.lit(False), F.lit(False), F.lit(0)).alias("e"),
    ).first()
    assert tuple(row) == (True, True, False, True, False)
    parts = [hashlib.md5(p).hexdigest() for p in (b"a", b"b")]
    want = hashlib.md5(b"".join(bytes.fromhex(p) for p in parts)).hexdigest()
    etags = F.array(*[F.lit(f'"{p}"') for p in parts])
    assert tuple(spark.range(1).select(B.upload_etag(etags), B.upload_etag(F.array(F.lit("x")))).first()) == (f'"{want}-2"', None)


def test_image_faults(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.db")
    db.execute("CREATE TABLE t(x)")
    db.commit()
    db.close()
    data = (tmp_path / "a.db").read_bytes()
    size = int.from_bytes(data[16:18], "big")
    bad = bytearray(data[:100])
    bad[21] = 0
    cases = [(data[:100], len(data), size), (data[:100], len(data), size * 2), (bytes(100), len(data), size), (bytes(bad), len(data), size), (data[:100], len(data) + size, size), (b"", 0, size)]
    df = spark.createDataFrame([(k, bytearray(h), n, p) for k, (h, n, p) in enumerate(cases)], "k int, h binary, n bigint, p int")
    got = [r.f for r in df.select("k", B.image_fault("h", "n", "p").alias("f")).orderBy("k").collect()]
    assert got == [None, "DatabasePageSizeMismatch" if len(data) % (size * 2) == 0 else "InvalidSQLiteDatabase", "InvalidSQLiteDatabase", "InvalidSQLiteDatabase", "InvalidSQLiteDatabase", None]
