import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelog.functions import checksums as C
from pagelog.functions import codec as K
from pagelog.operators import control, merge, validate
from pagelog.sources import logfiles, store, wal
from pagelog.streaming import capture


def plain_sums(data, big, start=(0, 0)):
    a, b = start
    for k in range(0, len(data), 8):
        x, y = (int.from_bytes(data[j : j + 4], "big" if big else "little") for j in (k, k + 4))
        a = (a + x + b) & 0xFFFFFFFF
        b = (b + y + a) & 0xFFFFFFFF
    return a, b


@pytest.mark.parametrize("big", [True, False])
@pytest.mark.parametrize("n", [0, 8, 16, 24, 4120])
def test_log_sums(big, n):
    data = random.Random(n).randbytes(n)
    assert C.wal_sums(data, big, (7, 9)) == plain_sums(data, big, (7, 9))


P = [bytes([k]) * 512 for k in range(6)]


@pytest.mark.parametrize("big", [True, False])
def test_frames(big):
    log = wal.build([(1, 0, P[1]), (2, 2, P[2]), (2, 2, P[3])], 512, big_endian=big)
    f = wal.Frames(log)
    assert [x[:3] for x in f] == [(0, 1, 0), (1, 2, 2), (2, 2, 2)] and f.stop == wal.END
    later = wal.Frames(log, 32 + 536)
    assert [x[0] for x in later] == [1, 2]
    for bad, stop, n in ((log[:-1], wal.TORN, 2), (log[: 32 + 536 + 8] + b"\0\0\0\7" + log[32 + 536 + 12 :], wal.SALT, 1), (log[:-1] + b"\xff", wal.SUMS, 2)):
        f = wal.Frames(bad)
        assert (len(list(f)), f.stop) == (n, stop)
    with pytest.raises(wal.WalError, match="InvalidOffset"):
        wal.Frames(log, 33)
    with pytest.raises(wal.WalError, match="InvalidMagic"):
        wal.header(b"\0" * 32)
    with pytest.raises(wal.WalError, match="HeaderChecksumMismatch"):
        wal.header(log[:24] + bytes(8))


def test_a_real_log(spark, tmp_path):
    """A log that the database library itself wrote, and the image it stands for."""
    db = sqlite3.connect(tmp_path / "a.db", isolation_level=None)
    db.execute("PRAGMA journal_mode=WAL")
    db.execute("PRAGMA wal_autocheckpoint=0")
    db.execute("CREATE TABLE t(x)")
    for k in range(50):
        db.execute("INSERT INTO t VALUES (?)", (f"row {k}" * 40,))
    db.execute("UPDATE t SET x = 'z' WHERE rowid % 7 = 0")
    frames = wal.read_frames(spark, f"file://{tmp_path}/a.db-wal")
    image = {r.page_number: bytes(r.data) for r in merge.page_map(frames).collect()}
    assert wal.read_logs(spark, f"file://{tmp_path}/a.db-wal").first().stop == wal.END
    db.execute("PRAGMA wal_checkpoint(FULL)")
    data = (tmp_path / "a.db").read_bytes()
    size = len(next(iter(image.values())))
    assert image == {k + 1: data[k * size : (k + 1) * size] for k in range(len(data) // size)}
    pages = logfiles.image_pages(spark, f"file://{tmp_path}/a.db", size)
    logfiles.write_image(pages, pages.count(), size, str(tmp_path / "copy.db"))
    assert (tmp_path / "copy.db").read_bytes() == data
    assert wal.salts((tmp_path / "a.db-wal").read_bytes()) != []


def test_oversized_file_gives_its_verdict(spark, tmp_path):
    (tmp_path / "0").mkdir()
    good = K.encode(K.Header(page_size=512, commit=1), [(1, P[1])])
    (tmp_path / "0" / "0000000000000001-0000000000000001.ltx").write_bytes(good)
    (tmp_path / "0" / "0000000000000002-0000000000000002.ltx").write_bytes(good + bytes(900))
    got = logfiles.read_files(spark, f"file://{tmp_path}", limits=K.Limits(max_input_bytes=len(good))).orderBy("size_bytes").collect()
    assert [(r.status, r.error, r.size_bytes, r.level) for r in got] == [("verified", None, len(good), 0), ("failed", "InputLimitExceeded", len(good) + 900, 0)]


def test_files_and_pages(spark, tmp_path):
    folder = tmp_path / "ltx" / "0"
    folder.mkdir(parents=True)
    good = K.encode(K.Header(page_size=512, commit=2), [(1, P[1]), (2, P[2])])
    (folder / "0000000000000001-0000000000000001.ltx").write_bytes(good)
    (folder / "0000000000000002-0000000000000002.ltx").write_bytes(good[:-1])
    (folder / "notes.ltx").write_bytes(b"")
    root = f"file://{tmp_path}/ltx"
    assert [(r.level, int(r.min_txid), r.size_bytes) for r in logfiles.listing(spark, root).orderBy("min_txid").collect()] == [(0, 1, len(good)), (0, 2, len(good) - 1)]
    rows = {r.path.rsplit("/", 1)[1][:16]: (r.status, r.error, r.page_count) for r in logfiles.read_files(spark, root).collect()}
    assert rows["0" * 15 + "1"] == ("verified", None, 2) and rows["0" * 15 + "2"] == ("failed", "TruncatedInput", None)
    pages = logfiles.read_pages(spark, root, strict=False)
    assert sorted((r.page_number, bytes(r.data), r.page_checksum) for r in pages.collect()) == [(k, P[k], logfiles._signed(C.page_checksum(k, P[k]))) for k in (1, 2)]
    post = K.decode(good).post_apply_checksum
    assert merge.database_checksum(pages, page_size=512).first()[0] == logfiles._signed(post)
    assert logfiles.read_files(spark, root, header_only=True).where("status = 'header'").count() == 2
    with pytest.raises(Exception, match="TruncatedInput"):
        logfiles.read_pages(spark, root).collect()


def test_publishing_is_idempotent(spark, tmp_path):
    one = spark.createDataFrame([("a", "x.bin", bytearray(b"12"))], "folder string, name string, content binary")
    root = f"file://{tmp_path}"
    assert [r.outcome for r in logfiles.publish(one, root).collect() + logfiles.publish(one, root).collect()] == ["written", "unchanged"]
    with pytest.raises(Exception, match="ObjectExists"):
        logfiles.publish(one.withColumn("content", F.lit(b"34")), root).collect()
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["x.bin"]


def test_image_store(spark, tmp_path):
    s = store.ImageStore(spark, f"file://{tmp_path}/s")
    assert s.current() is None
    rows = lambda v: spark.createDataFrame([(1, v)], "page_number bigint, fill int")
    s.publish(rows(1), 1, 0, 512, 1, batch=0)
    s.publish(rows(2), 2, 0, 512, 1, batch=1)
    assert s.publish(rows(9), 9, 0, 512, 1, batch=1).txid == 2  # the batch was committed already
    (tmp_path / "s" / "gen=7").mkdir()
    (tmp_path / "s" / "gen=1-left").mkdir()
    assert s.recover() == ["gen=1-left", "gen=7"]
    assert [s.read(g).first().fill for g in (0, 1, None)] == [1, 2, 2]
    lease = s.acquire(0)
    assert s.expire() == [] and lease.read().first().fill == 1
    lease.release()
    assert s.expire() == [0]
    with pytest.raises(store.StoreError, match="GenerationExpired"):
        s.acquire(0)
    with pytest.raises(store.StoreError, match="ObjectExists"):
        s.files.create("log/00000000000000000001.json", "{}")
    log = tmp_path / "s" / "log" / "00000000000000000001.json"
    log.write_text(log.read_text().replace("512", "513"))
    (tmp_path / "s" / "log" / ".00000000000000000001.json.crc").unlink()
    with pytest.raises(store.StoreError, match="ManifestCorrupt"):
        s.current()


def test_a_second_writer_loses_and_harms_nothing(spark, tmp_path, monkeypatch):
    s = store.ImageStore(spark, f"file://{tmp_path}/s")
    rows = lambda v: spark.createDataFrame([(1, v)], "page_number bigint, fill int")
    s.publish(rows(1), 1, 0, 512, 1)
    stale = s.current()
    s.publish(rows(2), 2, 0, 512, 1)
    monkeypatch.setattr(s, "current", lambda: stale)  # a writer that looked before the other committed
    with pytest.raises(store.StoreError, match="ObjectExists"):
        s.publish(rows(3), 2, 0, 512, 1)
    monkeypatch.undo()
    assert s.read().first().fill == 2 and s.recover() == []


def test_staged_apply(spark, tmp_path):
    s = store.ImageStore(spark, f"file://{tmp_path}/s")
    page = lambda d: spark.createDataFrame([(k, bytearray(P[v]), logfiles._signed(C.page_checksum(k, P[v]))) for k, v in d.items()], "page_number bigint, data binary, page_checksum bigint")
    total = lambda d: logfiles._signed(K.database_checksum(np.array([C.page_checksum(k, P[v]) for k, v in d.items()], np.uint64)))
    a = s.begin(512)
    a.stage(page({1: 1, 2: 2, 3: 3}), 1, 1, 3)
    a.stage(page({2: 4}), 2, 2, 2)
    with pytest.raises(store.StoreError, match="NonContiguousTransition"):
        a.stage(page({2: 4}), 4, 4, 2)
    assert a.publish(total({1: 1, 2: 4})).txid == 2 and s.current().commit == 2
    b = s.begin(512)
    b.stage(page({1: 5}), 3, 3, 2)
    with pytest.raises(store.StoreError, match="DatabaseChecksumMismatch"):
        b.publish(total({1: 1, 2: 4}))
    assert b.state == "aborted" and s.current().txid == 2 and b.settle() is None
    c = s.begin(512)
    c.stage(page({1: 3}), 1, 9, 1, snapshot=True)
    c.publish(total({1: 3}))
    assert c.settle() == s.current() and s.current().txid == 9 and s.read().count() == 1
    with pytest.raises(store.StoreError, match="PageSizeMismatch"):
        s.begin(1024)
    change = merge.checksum_update(page({1: 1, 2: 2}), page({2: 4})).first()[0]
    assert (total({1: 1, 2: 2}) ^ change) | -(1 << 63) == total({1: 1, 2: 4})


def test_objects(tmp_path):
    from pagelog.sources import objects

    assert len(objects.conformance(f"file://{tmp_path}")) == 13
    s = objects.Objects(f"file://{tmp_path}")
    w = s.begin("x/y")
    w.write(b"1")
    w.out.close()
    w.state = "indeterminate"  # as if the answer to the last step had been lost
    assert w.settle() == "aborted" and s.names() == []
    w = s.begin("x/y")
    w.write(b"1")
    w.out.close()
    s.put("x/y", b"1")
    w.state = "indeterminate"
    assert w.settle() == "written" and s.read("x/y") == b"1" and s.sweep() == 0
    r = objects.ObjectReader(s, "x/y", 1)
    s.put("x/z", b"123")
    r = objects.ObjectReader(s, "x/z", 2)
    assert r.read(1) == b"1"
    s.put_if_match("x/z", b"1234", s.generation("x/z"))
    with pytest.raises(objects.ObjectError, match="GenerationChanged"):
        r.read(3)
    with pytest.raises(objects.ObjectError, match="GenerationChanged"):
        r.read(1)  # a poisoned reader stays so


def test_controller(spark, tmp_path):
    c = control.Controller(spark, f"file://{tmp_path}", bounds=control.Bounds(max_inputs=2))
    page = lambda d: spark.createDataFrame([(k, bytearray(P[v])) for k, v in d.items()], "page_number bigint, data binary")
    image = lambda t=0: [(r.page_number, bytes(r.data)) for r in c.restore(t)[1].orderBy("page_number").collect()]
    c.sync(page({1: 1, 2: 2, 3: 3}), 3, 512, 10)
    c.sync(page({1: 4}), 1, 512, 20)
    c.sync(page({3: 5}), 3, 512, 30)
    want = [(1, P[4]), (2, bytes(512)), (3, P[5])]
    assert image() == want and image(1) == [(k, P[k]) for k in (1, 2, 3)]
    with pytest.raises(control.ControlError, match="TimestampRegression"):
        c.sync(page({1: 1}), 3, 512, 29)
    assert c.maintain(1, 4).kind == "idle"
    assert [c.maintain(1).kind for _ in range(3)] == ["compacted", "compacted", "idle"]
    assert image() == want
    assert [(r.level, int(r.min_txid), int(r.max_txid)) for r in c.listing().orderBy("min_txid").collect()] == [(1, 1, 2), (1, 3, 3)]
    with pytest.raises(Exception, match="TxNotAvailable"):
        c.restore(99)
    assert c.state == "ready"
    (tmp_path / "ltx" / "1" / "0000000000000003-0000000000000003.ltx").write_bytes(b"junk")
    with pytest.raises(Exception):
        c.restore()
    with pytest.raises(control.ControlError, match="Poisoned"):
        c.maintain(1)


def apply_in_turn(rows):
    """(image, size, frames not committed) of frames (index, page, commit, fill), straight from the definition."""
    image, size, pending = {}, 0, []
    for _, page, commit, fill in rows:
        pending.append((page, fill))
        if commit:
            image = {n: v for n, v in (image | dict(pending)).items() if n <= commit}
            size, pending = commit, []
    return image, size, pending


def stream(spark, tmp_path, parts, schema, tag, **more):
    src = f"file://{tmp_path}/{tag}-in"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        capture.start(spark.readStream.schema(schema).parquet(src), f"file://{tmp_path}/{tag}", f"file://{tmp_path}/{tag}-ck", availableNow=True, **more).awaitTermination()
    return {x.page_number: x.fill for x in store.ImageStore(spark, f"file://{tmp_path}/{tag}").read().collect()}


def test_streaming_capture(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, r.randint(1, 6), r.choice([0, 0, 1, 4, 6]), k * 10) for k in range(60)]
    schema = "frame_index bigint, page_number bigint, commit_pages bigint, fill int"
    want = apply_in_turn(rows)[0]
    for tag, cuts in (("a", (0, 20, 40, 60)), ("b", (0, 60)), ("c", (0, 7, 13, 60))):
        assert stream(spark, tmp_path, [rows[lo:hi] for lo, hi in zip(cuts, cuts[1:])], schema, tag) == want, tag
    s = store.ImageStore(spark, f"file://{tmp_path}/a")
    before = s.current()
    capture._fold(s, spark.createDataFrame(rows[:3], schema), before.batch, 4096, None, None, None)  # a batch that runs again
    assert s.current() == before


def test_streams_in_layers(spark, tmp_path, monkeypatch):
    """Each batch writes what changed; the image is read from its layers, and written whole when they are too many."""
    monkeypatch.setattr(store, "LAYERS", 3)
    r = random.Random(9)
    rows = [(k, r.randint(1, 9), r.choice([0, 2, 5, 9]), k) for k in range(70)]
    schema, s = "frame_index bigint, page_number bigint, commit_pages bigint, fill int", store.ImageStore(spark, f"file://{tmp_path}/s")
    for k in range(7):
        capture._fold(s, spark.createDataFrame(rows[10 * k : 10 * k + 10], schema), k, 512, None, None, None)
        cut = max((i for i, _, c, _ in rows[: 10 * k + 10] if c), default=-1)
        want = apply_in_turn(rows[: cut + 1])[0]
        assert {x.page_number: x.fill for x in s.read().collect()} == want, k
    assert [len(s.entry(n).layers) for n in s.entries()] == [1, 2, 3, 1, 2, 3, 1]
    lease = s.acquire(4)
    assert s.expire() == [0, 1, 2, 5] and lease.read().count() and s.recover() == []
    lease.release()
    assert s.expire() == [3, 4] and s.read().count() == len(want)


def test_streams_of_several_segments(spark, tmp_path):
    schema = "frame_index bigint, page_number bigint, commit_pages bigint, fill int, salt string"
    old = [(0, 1, 0, 10, "x"), (1, 2, 2, 11, "x"), (2, 1, 0, 12, "x")]  # the last is never committed
    new = [(3, 2, 3, 20, "y"), (4, 3, 3, 21, "y")]
    database = lambda: spark.createDataFrame([(-1, 1, 1), (-1, 2, 2)], "frame_index bigint, page_number bigint, fill int").withColumn("salt", F.lit("db"))
    for tag, parts in (("one", [old + new]), ("two", [old, new]), ("three", [old + new[:1], new[1:]])):
        assert stream(spark, tmp_path, parts, schema, tag, salt="salt", snapshot=database) == {1: 1, 2: 20, 3: 21}, tag
    with pytest.raises(Exception, match="SegmentMissing"):
        stream(spark, tmp_path, [old, new], schema, "none", salt="salt")


def test_stream_clock(spark, tmp_path):
    schema = "frame_index bigint, page_number bigint, commit_pages bigint, fill int, at timestamp"
    import datetime as dt

    t = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k)
    ok = [[(0, 1, 1, 5, t(1))], [(1, 1, 1, 6, t(2))]]
    assert stream(spark, tmp_path, ok, schema, "up", clock="at") == {1: 6}
    with pytest.raises(Exception, match="TimestampRegression"):
        stream(spark, tmp_path, ok[::-1], schema, "down", clock="at")


def test_interval_counts(spark, tmp_path):
    import datetime as dt

    schema, src = "page_number bigint, ts timestamp", f"file://{tmp_path}/in"
    rows = [(k % 5, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * k)) for k in range(40)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    q = capture.interval_counts(spark.readStream.schema(schema).parquet(src), "ts").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.frames for r in spark.table("counts").collect()) == 40


def test_capture_from_a_log(spark, tmp_path):
    from pagelog.operators import walsync

    P = [bytes([k]) * 512 for k in range(10)]  # noqa: N806
    db, log = tmp_path / "a.db", tmp_path / "a.db-wal"
    c = control.Controller(spark, f"file://{tmp_path}/r")
    cap = walsync.Capture(c, f"file://{db}", f"file://{log}", walsync.Policy(max_frames=4))
    put = lambda frames, salt=(1, 2): log.write_bytes(wal.build(frames, 512, salt))
    image = lambda: [bytes(r.data) for r in c.restore()[1].orderBy("page_number").collect()]
    db.write_bytes(P[7] + P[8])
    with pytest.raises(walsync.CaptureError, match="LogMissing"):
        cap.sync(1)
    frames = [(1, 0, P[1]), (2, 2, P[2])]
    put(frames)
    one = cap.sync(10)
    assert (one.kind, one.reason, one.state.position.txid, one.checkpoint_due) == ("full", "first", 1, False) and image() == [P[1], P[2]]
    assert cap.sync(11).kind == "unchanged"
    frames += [(1, 0, P[3])]
    put(frames)
    assert cap.sync(12).kind == "unchanged"  # not committed yet
    frames += [(4, 4, P[4])]
    put(frames)
    two = cap.sync(13)
    assert (two.kind, two.state.commit, two.checkpoint_due) == ("incremental", 4, True) and image() == [P[3], P[2], bytes(512), P[4]]
    head = logfiles.read_files(spark, f"file://{tmp_path}/r/ltx").where("min_txid = 2").first()
    assert (head.wal_offset, head.wal_size, head.wal_salt_1, head.wal_salt_2) == (32 + 2 * 536, 2 * 536, 1, 2)
    db.write_bytes(P[3] + P[2] + bytes(512) + P[4])  # a checkpoint, after which the log starts anew
    cap.checkpointed(14)
    put([(2, 3, P[5])], (3, 4))
    three = cap.sync(15)
    assert (three.kind, three.reason) == ("full", "salt") and image() == [P[3], P[5], bytes(512)]
    put([(2, 3, P[6]), (1, 3, P[6])], (3, 4))  # same salts, other frames: the end is no longer where it was
    four = cap.sync(16)
    assert (four.kind, four.reason) == ("full", "previous_frame") and image() == [P[6], P[6], bytes(512)]
    assert walsync.sidecars(spark, f"file://{db}") == ["a.db-wal"]
    with pytest.raises(walsync.CaptureError, match="SidecarPresent"):
        walsync.reject_sidecars(spark, f"file://{db}")
    with pytest.raises(wal.WalError, match="InvalidMagic"):
        log.write_bytes(bytes(64))
        cap.sync(17)


def test_startup_and_bounds(spark, tmp_path):
    root = f"file://{tmp_path}"
    c = control.Controller(spark, root)
    page = lambda d: spark.createDataFrame([(k, bytearray(P[v])) for k, v in d.items()], "page_number bigint, data binary")
    assert c.start("require_empty")[0].txid == 0
    c.sync(page({1: 1, 2: 2}), 2, 512, 1)
    c.sync(page({2: 3}), 2, 512, 2)
    with pytest.raises(control.ControlError, match="ReplicaNotEmpty"):
        c.start("require_empty")
    at, image = c.start("restore_latest")
    assert at.txid == 2 and {r.page_number: bytes(r.data) for r in image.collect()} == {1: P[1], 2: P[3]}
    assert c.start("verified_local", at, page({1: 1, 2: 3}))[0] == at and c.verify() == at
    with pytest.raises(control.ControlError, match="DivergentHistory"):
        c.start("verified_local", at, page({1: 1, 2: 2}))
    with pytest.raises(control.ControlError, match="PositionMismatch"):
        c.start("verified_local", control.Position(1), page({1: 1, 2: 3}))
    for bounds, error in ((control.Bounds(max_image_pages=1), "PageLimitExceeded"), (control.Bounds(max_image_bytes=600), "OutputLimitExceeded"), (control.Bounds(max_total_pages=2), "PageLimitExceeded")):
        with pytest.raises(control.ControlError, match=error):
            control.Controller(spark, root, bounds=bounds).restore()
    with pytest.raises(Exception, match="PlanCapacityExceeded"):
        control.Controller(spark, root, bounds=control.Bounds(max_files=1, max_inputs=1)).restore()
    with pytest.raises(control.ControlError, match="InvalidConfiguration"):
        control.Bounds(max_files=1, max_inputs=2)
    n = control.Counters(a=control.Counters.MOST - 1)
    n.add("a")
    assert not n.saturated
    n.add("a")
    assert n.saturated and n["a"] == control.Counters.MOST


def test_older_files_are_compacted_into_current_ones(spark, tmp_path):
    import struct

    import xxhash

    def old(header, pages):
        """A file of the version before: framed pages without sizes."""
        out, logical, index = [header.pack()], [header.pack()], []
        at = 100
        for n, data in pages:
            block = K.lz4_compress(data)
            desc = struct.pack("<IBB", K.LZ4_MAGIC, K.LZ4_FLAGS, K.LZ4_BLOCKS)
            frame = desc + bytes([xxhash.xxh32_intdigest(desc[4:]) >> 8 & 255]) + struct.pack("<I", len(block)) + block + bytes(4) + struct.pack("<I", xxhash.xxh32_intdigest(data))
            out.append(struct.pack(">I", n) + frame)
            logical.append(struct.pack(">I", n) + data)
            index.append((n, at, 4 + len(frame)))
            at += 4 + len(frame)
        tail = bytes(4) + (e := b"".join(K.uvarint(v) for x in index for v in x) + b"\0") + struct.pack(">QQ", len(e), 0)
        return b"".join([*out, tail, struct.pack(">Q", C.crc64(b"".join([*logical, tail])) | K.FLAG)])

    c = control.Controller(spark, f"file://{tmp_path}", versions={"0/0000000000000001-0000000000000001.ltx": "v2"})
    folder = tmp_path / "ltx" / "0"
    folder.mkdir(parents=True)
    (folder / "0000000000000001-0000000000000001.ltx").write_bytes(old(K.Header(flags=2, page_size=512, commit=2), [(1, P[1]), (2, P[2])]))
    c.sync(spark.createDataFrame([(2, bytearray(P[3]))], "page_number bigint, data binary"), 2, 512, 5)
    assert c.maintain(1).pages == 2
    one = logfiles.read_files(spark, f"file://{tmp_path}/ltx/1").first()
    assert (one.status, int(one.min_txid), int(one.max_txid), one.page_count) == ("verified", 1, 2, 2)
    assert {r.page_number: bytes(r.data) for r in c.restore()[1].collect()} == {1: P[1], 2: P[3]}


def test_index_and_ranges(spark, tmp_path):
    from pagelog.sources import objects

    data = K.encode(K.Header(page_size=512, commit=3), [(k, P[k]) for k in (1, 2, 3)])
    (tmp_path / "a.ltx").write_bytes(data)
    (tmp_path / "b.ltx").write_bytes(data[:-3])
    got = logfiles.read_index(spark, f"file://{tmp_path}").orderBy("path", "entry").collect()
    assert [(r.page_number, r.frame_offset_bytes, r.frame_size_bytes) for r in got[:3]] == K.decode(data).index and got[3].error is not None
    ok = logfiles.read_pages(spark, f"file://{tmp_path}", strict=False)
    seen = ok.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("frame_offset_bytes")) - 1).cast("bigint").alias("entry"), "page_number", "frame_offset_bytes", "frame_size_bytes")
    index = logfiles.read_index(spark, f"file://{tmp_path}").where("error is null").drop("error")
    assert validate.index_mismatch(index, seen).isEmpty()
    assert validate.index_mismatch(index.where("entry < 2"), seen).count() == 1
    ask = spark.createDataFrame([("a.ltx", 0, 100), ("a.ltx", len(data) - 16, 16), ("a.ltx", 1, len(data)), ("none", 0, 1)], "name string, offset bigint, length bigint")
    out = objects.ranges(spark, f"file://{tmp_path}", ask).collect()
    assert [(r.data and bytes(r.data), r.error) for r in out] == [(data[:100], None), (data[-16:], None), (None, "InvalidRange"), (None, "ObjectNotFound")]
    K.Header.unpack(bytes(out[0].data)).check()
    late = spark.createDataFrame([("p", 1, 5), ("p", 2, 4), ("q", 1, 1)], "part string, k int, t int")
    assert [(r.part, r.k) for r in validate.clock_regressions(late, "part", "k", "t").collect()] == [("p", 2)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 65])
def test_sums_of_pieces_join(n):
    r = np.random.default_rng(n)
    for size in (4, 10, 24, 512):
        rows = r.integers(0, 256, (n, size), np.uint8)
        whole = rows.tobytes()
        state = C.after(C.ONES, C.joined(C.remainders(rows), size), n * size)[0] if n else C.ONES
        assert int(state) ^ C.ONES == C.crc64(whole)
