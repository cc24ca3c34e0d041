"""Many quanta towards a level done together: the same tree as one after the other."""

import random
import shutil

import duckdb
import pytest

from pagelog.functions import codec as K
from pagelog.operators import catalog, control
from pagelog.plans import registry
from tests.duck import same


def tree(root, n=11, odd=None):
    """n files of level 0, one transaction each, of pages 1..commit."""
    rng = random.Random(n)
    folder = root / "ltx" / "0"
    folder.mkdir(parents=True)
    for t in range(1, n + 1):
        commit = rng.randint(4, 9)
        pages = [(p, bytes([t]) * 512) for p in range(1, commit + 1) if t == 1 or rng.random() < 0.5]
        head = K.Header(flags=2, page_size=512, commit=commit, min_txid=t, max_txid=t, timestamp_ms=t)
        (folder / f"{t:016x}-{t:016x}.ltx").write_bytes(b"junk" if t == odd else K.encode(head, pages))


def files(root):
    return {str(f.relative_to(root)): f.read_bytes() for f in sorted(root.rglob("*.ltx"))}


def controller(spark, root, **bounds):
    return control.Controller(spark, f"file://{root}", bounds=control.Bounds(max_inputs=3, **bounds))


def counted(monkeypatch):
    seen, listing = [], control.Controller.listing
    monkeypatch.setattr(control.Controller, "listing", lambda self: (seen.append(1), listing(self))[1])
    return seen


def test_a_level_equals_its_quanta(spark, tmp_path, monkeypatch):
    a, b = tmp_path / "a", tmp_path / "b"
    tree(a)
    shutil.copytree(a, b)
    one, all_ = controller(spark, a), controller(spark, b)
    want = []
    while (done := one.maintain(1, 3)).kind != "idle":
        want.append(done)
    seen = counted(monkeypatch)
    assert all_.maintain_level(1, 3) == want and len(want) == 3
    assert files(a) == files(b) and one.counters == all_.counters
    assert len(seen) == 2  # one for the work, one that finds none


def test_waves_and_most(spark, tmp_path, monkeypatch):
    a, b = tmp_path / "a", tmp_path / "b"
    tree(a)
    shutil.copytree(a, b)
    controller(spark, a).maintain_level(1)
    monkeypatch.setattr(control, "WAVE", 4)  # a wave ends within the second batch, which waits for the next
    c = controller(spark, b)
    assert len(c.maintain_level(1, most=1)) == 1 and len(files(b)) == 9
    assert [x.inputs for x in c.maintain_level(1)] == [3, 3, 2] and files(a) == files(b)


def test_batches_before_a_fault_are_done(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    tree(a, odd=8)
    shutil.copytree(a, b)
    one, all_ = controller(spark, a), controller(spark, b)
    with pytest.raises(control.ControlError) as want:
        while one.maintain(1).kind != "idle":
            pass
    with pytest.raises(control.ControlError) as got:
        all_.maintain_level(1)
    assert str(got.value) == str(want.value) and all_.state == "poisoned"
    assert files(a) == files(b) and len([f for f in files(a) if f.startswith("ltx/1/")]) == 2


def test_page_bound_of_a_batch(spark, tmp_path):
    tree(tmp_path)
    most = max(sum(len(K.decode(c).pages) for c in list(files(tmp_path).values())[k : k + 3]) for k in (0, 3, 6, 9))
    with pytest.raises(control.ControlError, match="PageLimitExceeded"):
        controller(spark, tmp_path, max_total_pages=most - 1).maintain_level(1)
    assert [x.inputs for x in controller(spark, tmp_path, max_total_pages=most).maintain_level(1)]


def test_batches_equal_prefixes(spark):
    rng = random.Random(5)
    rows = [(0, t, t, rng.randint(1, 60)) for t in range(1, 40)]
    df = spark.createDataFrame(rows, "level int, min_txid int, max_txid int, size_bytes bigint")
    listed = df.collect()
    for inputs, room, least in ((4, 120, 1), (7, 1000, 3), (3, 60, 2)):
        want, rest = [], df
        while catalog.batch_due(rest, least) and (part := catalog.compaction_prefix(rest, inputs, room).collect()):
            want.append([r.min_txid for r in part])
            rest = df.where(f"min_txid > {part[-1].max_txid}")
        assert [[r.min_txid for r in x] for x in catalog.batches(listed, inputs, room, 99, least)] == want
    gap = listed[:9] + listed[10:]
    assert [len(x) for x in catalog.batches(gap, 4, 1000, 99)] == [4, 4] and [len(x) for x in catalog.batches(gap[7:], 4, 1000, 99)] == [4]


@pytest.fixture(scope="module")
def longer(sf_dir, tmp_path_factory):
    """sf0.001's events fifty times over with keys shifted: a hundred files of level 0, and pages that are cut and not written again."""
    d = tmp_path_factory.mktemp("longer")
    duckdb.execute(f"COPY (SELECT event_id + k * 1000 AS event_id, user_id + k * 15 AS user_id, * EXCLUDE (event_id, user_id) FROM '{sf_dir}/events.parquet', range(50) r(k)) TO '{d}/events.parquet'")
    return str(d)


@pytest.mark.parametrize("name", ["controller_levels", "restore_after_compaction"])
def test_queries_on_more_files(spark, longer, monkeypatch, name):
    seen = counted(monkeypatch)
    same(registry.QUERIES[name](spark, longer), longer, registry.ORACLE[name])
    assert len(seen) == 3  # however many quanta there are
