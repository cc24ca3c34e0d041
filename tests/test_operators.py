import random

import pytest
from pyspark.sql import functions as F

from pagelog.functions import exprs
from pagelog.operators import catalog, merge, prefix, validate
from pagelog.sources import scratch

INFO = "level int, min_txid bigint, max_txid bigint, size_bytes bigint, created_at_ms bigint"


def files(spark, *rows):
    return spark.createDataFrame([(lv, lo, hi, 100, None) for lv, lo, hi in rows], INFO)


def plan(df):
    return [(r.level, r.min_txid, r.max_txid) for r in df.collect()]


L0 = ((0, 1, 1), (0, 2, 2), (0, 3, 3))


@pytest.mark.parametrize(
    ("rows", "target", "want"),
    [
        (L0, 0, [(0, 1, 1), (0, 2, 2), (0, 3, 3)]), (L0, 2, [(0, 1, 1), (0, 2, 2)]), (L0, 9, "TxNotAvailable"), ((), 0, "TxNotAvailable"),
        ((*L0, (1, 1, 2)), 0, [(1, 1, 2), (0, 3, 3)]), (((0, 1, 1), (0, 2, 2), (0, 4, 4), (1, 1, 2)), 0, "NonContiguousPlan"),
        (((0, 1, 1), (0, 2, 2), (0, 4, 4), (1, 1, 2)), 2, [(1, 1, 2)]), (((0, 4, 4), (9, 1, 1), (9, 1, 3)), 0, [(9, 1, 3), (0, 4, 4)]), (((0, 4, 4), (9, 1, 1), (9, 1, 3)), 1, [(9, 1, 1)]),
    ],
)
@pytest.mark.parametrize("local", [0, catalog.LOCAL_STEPS])
def test_restore_plans(spark, rows, target, want, local):
    df = files(spark, *rows)
    if isinstance(want, str):
        with pytest.raises(catalog.PlanError, match=want):
            catalog.restore_plan(df, target, local=local)
    else:
        assert plan(catalog.restore_plan(df, target, local=local)) == want


def greedy(rows, target):
    snaps = [r for r in rows if r[0] == 9 and (not target or r[2] <= target)]
    out = [max(snaps, key=lambda r: (r[2], r[1]))] if snaps else []
    at = out[0][2] if out else 0
    while not (target and at >= target):
        ok = [r for r in rows if r[0] < 9 and r[1] <= at + 1 and r[2] > at and (not target or r[2] <= target)]
        if not ok:
            break
        out.append(max(ok, key=lambda r: (r[2], -r[1], r[0])))
        at = out[-1][2]
    if not out or (target and at < target):
        return "TxNotAvailable"
    if not target and any(r[0] < 9 and r[1] > at + 1 for r in rows):
        return "NonContiguousPlan"
    return out


def test_plan_capacity(spark):
    assert len(plan(catalog.restore_plan(files(spark, *L0), max_files=3))) == 3
    with pytest.raises(catalog.PlanError, match="PlanCapacityExceeded"):
        catalog.restore_plan(files(spark, *L0), max_files=2)


@pytest.mark.parametrize("local", [0, catalog.LOCAL_STEPS])
def test_restore_plan_equals_the_greedy_walk(spark, local):
    r = random.Random(3)
    for _ in range(3):
        rows = {(9, 1, r.randint(1, 10))} | {(lv, lo, lo + r.randint(0, w)) for lv, w in ((0, 0), (1, 4), (2, 9)) for lo in r.sample(range(1, 40), 18)}
        target = r.choice([0, r.randint(1, 40)])
        want = greedy(sorted(rows), target)
        if isinstance(want, str):
            with pytest.raises(catalog.PlanError, match=want):
                catalog.restore_plan(files(spark, *rows), target, local=local)
        else:
            assert plan(catalog.restore_plan(files(spark, *rows), target, local=local)) == want


def test_walk_by_joins(spark):
    scratch.set_checkpoint_dir(spark)
    steps = spark.createDataFrame([(k, k + 3) for k in range(0, 60)], "reach bigint, max_txid bigint")
    want = {0, *range(3, 63, 3)}
    assert {r.reach for r in catalog.walk(steps, 0, local=5).collect()} == want == {r.reach for r in catalog.walk(steps, 0).collect()}
    assert [r.reach for r in catalog.walk(steps.where("false"), 7, local=0).collect()] == [7]


def test_compaction_plans(spark):
    two = files(spark, (0, 1, 1), (0, 2, 2))
    chosen, seek = catalog.compaction_plan(two, files(spark), 8, 1000)
    assert (chosen.count(), seek) == (2, 1)
    assert catalog.compaction_plan(two, files(spark), 8, 150)[0].count() == 1
    assert catalog.compaction_plan(two, files(spark), 8, 50)[0].count() == 0
    with pytest.raises(catalog.PlanError, match="CompactionNotAvailable"):
        catalog.compaction_plan(two, files(spark, (1, 1, 2)), 8, 1000)


def test_retention(spark):
    lower, upper = files(spark, (0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 5, 5)), files(spark, (1, 1, 3))
    assert sorted(plan(catalog.retention(lower, upper))) == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert plan(catalog.retention(lower, upper, 2)) == [(0, 1, 1), (0, 2, 2)]
    assert catalog.retention(lower, files(spark)).count() == 0


def test_ladder():
    ladder = catalog.Ladder()
    assert (ladder.interval_start(1, 95_000), ladder.interval_next(1, 95_000), ladder.interval_start(0, 95_000)) == (90_000, 120_000, 95_000)
    assert (ladder.previous(9), ladder.next(3), ladder.next(9), ladder.previous(0)) == (3, 9, None, None)
    with pytest.raises(catalog.PlanError, match="InvalidLevels"):
        catalog.Ladder((catalog.Level(0, 5),))
    with pytest.raises(catalog.PlanError, match="InvalidLevel"):
        ladder.interval_ms(9)


def chain(spark, *inputs):
    heads = spark.createDataFrame([(k, c, k + 1, k + 1, 4096) for k, (c, _) in enumerate(inputs)], "input_ordinal bigint, commit bigint, min_txid bigint, max_txid bigint, page_size int")
    pages = spark.createDataFrame([(k, n, v) for k, (_, p) in enumerate(inputs) for n, v in p.items()], "input_ordinal bigint, page_number bigint, fill int")
    return heads, pages


def got(df):
    return {r.page_number: r.fill for r in df.collect()}


def apply_in_turn(inputs):
    image, size = {}, 0
    for commit, pages in inputs:
        image = {n: v for n, v in image.items() if n <= min(size, commit)} | pages
        size = commit
    return {n: v for n, v in image.items() if n <= size}


REGROW = ((5, {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}), (3, {1: 6}), (5, {4: 7}))


def test_compaction_and_replay_differ_on_regrown_pages(spark):
    heads, pages = chain(spark, *REGROW)
    assert got(merge.compact(pages, heads)) == {1: 6, 2: 2, 3: 3, 4: 7, 5: 5}
    assert got(merge.replay(pages, heads)) == {1: 6, 2: 2, 3: 3, 4: 7} == apply_in_turn(REGROW)


def test_replay_equals_apply_in_turn(spark):
    r = random.Random(5)
    for _ in range(4):
        inputs = []
        for _ in range(r.randint(1, 8)):
            c = r.randint(0, 9)
            inputs.append((c, {n: r.randrange(100) for n in r.sample(range(1, c + 1), r.randint(0, c))}))
        heads, pages = chain(spark, *inputs)
        assert got(merge.replay(pages, heads)) == apply_in_turn(inputs)


def test_overlay_and_zero_fill(spark):
    page = lambda d: spark.createDataFrame(list(d.items()), "page_number bigint, fill int")
    assert got(merge.apply_overlay(page({1: 1, 2: 2, 4: 4}), page({2: 9, 3: 8}), 3, ["fill"])) == {1: 1, 2: 9, 3: 8}
    assert got(merge.zero_fill(page({2: 9}), 3, 4096, {"fill": F.lit(0)})) == {1: 0, 2: 9, 3: 0}


@pytest.mark.parametrize("width", [1, 3, 100])
def test_running_aggregates(spark, width):
    r = random.Random(width)
    values = [(k, r.randint(-5, 9)) for k in r.sample(range(40), 25)]
    df = spark.createDataFrame(values, "k bigint, v bigint")
    for how, exclusive in (("sum", False), ("sum", True), ("max", False), ("max", True)):
        out = {x.k: x.o for x in prefix.running(df, "k", F.col("v"), "o", how, width, exclusive).collect()}
        for k, _ in values:
            seen = [v for j, v in values if j < k or (j == k and not exclusive)]
            assert out[k] == ((sum if how == "sum" else max)(seen) if seen else (0 if how == "sum" else None))


def test_contiguity(spark):
    rows = [(0, 1, 1, 0, -5, 0), (1, 2, 2, -5, -6, 0), (2, 4, 4, -6, -7, 0), (3, 5, 5, -9, -8, 0), (4, 6, 6, 0, 0, 2)]
    df = spark.createDataFrame(rows, "input_ordinal bigint, min_txid bigint, max_txid bigint, pre_apply_checksum bigint, post_apply_checksum bigint, flags int").withColumn("path", F.lit("a"))
    want = {2: "NonContiguousTransition", 3: "DivergentHistory"}
    assert {r.input_ordinal: r.fault for r in catalog.contiguity_breaks(df).collect()} == want
    assert {r.input_ordinal: r.fault for r in catalog.contiguity_breaks(df, partition="path").collect()} == want


def test_compatibility(spark):
    heads, _ = chain(spark, (1, {}), (1, {}))
    plain = heads.withColumn("flags", F.lit(0))
    assert validate.compatible(plain) is None
    assert validate.compatible(plain.withColumn("page_size", F.col("input_ordinal"))) == "CompactionPageSizeMismatch"
    assert validate.compatible(plain.withColumn("flags", F.col("input_ordinal").cast("int") * 2)) == "CompactionChecksumModeMismatch"
    assert validate.compatible(plain.withColumn("min_txid", F.col("min_txid") * 5)) == "NonContiguousTransition"
    assert validate.compatible(plain.where("false")) == "CompactionInputRequired"


def test_scalars(spark):
    big = (1 << 64) - 1
    row = spark.createDataFrame([(str(big), 1024)], "t string, n int").select(
        exprs.format_txid(F.col("t").cast("decimal(20,0)")).alias("text"), exprs.next_txid(F.col("t")).alias("after"), exprs.lock_page("n").alias("lock"),
        exprs.parse_txid(F.lit("FFFFFFFFFFFFFFFF")).alias("parsed"), exprs.parse_txid(F.lit("12")).alias("short"),
        exprs.parse_file_name(F.lit("0000000000000002-0000000000000001.ltx")).alias("reversed"), exprs.file_path("r", F.lit(3), F.lit(1), F.lit(2)).alias("path"),
        exprs.object_key("a b", F.lit(9), F.lit(1), F.lit(2)).alias("key"), exprs.timestamp_text(F.lit(1500)).alias("ts"), exprs.timestamp_text(F.lit(2000)).alias("whole"),
        exprs.committed_frames(F.lit(32 + 2 * 4120), F.lit(4096)).alias("frames"), exprs.committed_frames(F.lit(33), F.lit(4096)).alias("torn"),
    ).first()
    assert (row.text, row.after, row.lock, int(row.parsed), row.short, row.reversed) == ("f" * 16, None, 1048577, big, None, None)
    assert row.path == "r/ltx/3/0000000000000001-0000000000000002.ltx" and row.key == "/a%20b/0009/0000000000000001-0000000000000002.ltx"
    assert (row.ts, row.whole, row.frames, row.torn) == ("1970-01-01T00:00:01.5Z", "1970-01-01T00:00:02Z", 2, None)
