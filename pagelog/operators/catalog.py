"""Planning over a catalog of files: (level, min_txid, max_txid, size_bytes, created_at_ms)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelog.functions import exprs
from pagelog.operators import prefix
from pagelog.sources import scratch

SNAPSHOT_LEVEL = exprs.SNAPSHOT_LEVEL


class PlanError(ValueError):
    """A plan that does not exist; the message is the error's name."""


@dataclass(frozen=True)
class Level:
    level: int
    interval_ms: int


@dataclass(frozen=True)
class Ladder:
    """Levels 0..k with their compaction intervals; level 0 alone has none, and the snapshot level stands above all."""

    levels: tuple[Level, ...] = (Level(0, 0), Level(1, 30_000), Level(2, 300_000), Level(3, 3_600_000))

    def __post_init__(self):
        ok = bool(self.levels) and all(x.level == k < SNAPSHOT_LEVEL and x.interval_ms >= 0 and (x.interval_ms == 0) == (k == 0) for k, x in enumerate(self.levels))
        if not ok:
            raise PlanError("InvalidLevels")

    @property
    def top(self) -> int:
        return len(self.levels) - 1

    def __contains__(self, level: int) -> bool:
        return level == SNAPSHOT_LEVEL or 0 <= level <= self.top

    def interval_ms(self, level: int) -> int:
        if not 0 <= level <= self.top:
            raise PlanError("InvalidLevel")
        return self.levels[level].interval_ms

    def previous(self, level: int) -> int | None:
        return self.top if level == SNAPSHOT_LEVEL else level - 1 if level > 0 else None

    def next(self, level: int) -> int | None:
        if level == SNAPSHOT_LEVEL:
            return None
        return SNAPSHOT_LEVEL if level == self.top else level + 1 if level + 1 in self else None

    def interval_start(self, level: int, now_ms: int) -> int:
        i = self.interval_ms(level)
        return now_ms - now_ms % i if i else now_ms

    def interval_next(self, level: int, now_ms: int) -> int:
        return self.interval_start(level, now_ms) + self.interval_ms(level)


def listing(files: DataFrame, level: int | None = None, seek: int = 0, limit: int | None = None) -> DataFrame:
    """Files of a level from ``seek`` on, ascending; more than ``limit`` of them is an error, never a cut."""
    out = files.where(F.col("min_txid") >= seek)
    out = out if level is None else out.where(F.col("level") == level)
    if limit is not None and out.limit(limit + 1).count() > limit:
        raise PlanError("ListingCapacityExceeded")
    return out.orderBy("level", "min_txid", "max_txid")


def listing_faults(files: DataFrame, max_bytes: int = (1 << 63) - 1) -> DataFrame:
    """Rows that a valid listing may not have, each with its fault."""
    w = Window.partitionBy("level").orderBy("min_txid", "max_txid")
    same = (F.lag("min_txid").over(w) == F.col("min_txid")) & (F.lag("max_txid").over(w) == F.col("max_txid"))
    fault = (
        F.when(~F.col("level").between(0, SNAPSHOT_LEVEL), "level").when((F.col("min_txid") < 1) | (F.col("min_txid") > F.col("max_txid")), "range")
        .when((F.col("size_bytes") < 1) | (F.col("size_bytes") > max_bytes), "size").when((F.col("level") == SNAPSHOT_LEVEL) & (F.col("min_txid") != 1), "snapshot")
        .when(F.coalesce(same, F.lit(False)), "order")
    )
    return files.withColumn("fault", fault).where("fault is not null")


def contiguity_breaks(headers: DataFrame, order: str = "input_ordinal", partition: str | None = None) -> DataFrame:
    """Inputs that do not continue their predecessor, with the first error that holds.

    A chain is one partition's rows in order; with no partition, ordinals must be dense, and the predecessor is found by an
    equi-join on the ordinal instead of a scan in one task.
    """
    if partition:
        w = Window.partitionBy(partition).orderBy(order)
        rows = headers.select("*", F.lag("max_txid").over(w).alias("__txid"), F.lag("post_apply_checksum").over(w).alias("__post")).where("__txid is not null")
    else:
        before = headers.select((F.col(order) + 1).alias(order), F.col("max_txid").alias("__txid"), F.col("post_apply_checksum").alias("__post"))
        rows = headers.join(before, order)
    gap = F.col("min_txid") != F.col("__txid") + 1
    split = ~exprs.no_checksum() & (F.col("pre_apply_checksum") != F.col("__post"))
    fault = F.when(gap, "NonContiguousTransition").when(split, "DivergentHistory")
    return rows.withColumn("fault", fault).where("fault is not null").drop("__txid", "__post")


def newest_snapshot(files: DataFrame, target: int = 0) -> DataFrame:
    """The snapshot that reaches furthest, not beyond a target."""
    s = files.where(F.col("level") == SNAPSHOT_LEVEL)
    s = s.where(F.col("max_txid") <= target) if target else s
    return s.agg(F.max_by(F.struct(*files.columns), F.struct("max_txid", "min_txid")).alias("s")).where("s is not null").select("s.*")


def _better() -> Column:
    """Longer reach, then wider cover, then higher level, then earlier creation where both are known."""
    return F.struct(F.col("max_txid").alias("max_txid"), (-F.col("min_txid")).alias("neg_min"), F.col("level").alias("level"), F.coalesce(-F.col("created_at_ms"), F.lit(-(1 << 62))).alias("neg_created"), F.col("size_bytes").alias("size_bytes"), F.col("created_at_ms").alias("created_at_ms"))


def successors(files: DataFrame, starts: DataFrame) -> DataFrame:
    """(reach, min_txid, max_txid, level, ...): for each reach, the best file that starts at most one past it and ends beyond it.

    Files ordered by their start carry the best seen so far, a running maximum; a reach looks up the last one it can use.
    """
    best = files.groupBy("min_txid").agg(F.max(_better()).alias("best")).select(F.col("min_txid").alias("at"), "best", F.lit(None).cast("bigint").alias("reach"))
    asks = starts.select((F.col("reach") + 1).alias("at"), F.lit(None).cast(best.schema["best"].dataType).alias("best"), "reach")
    seen = prefix.running(best.union(asks), "at", F.col("best"), "best_so_far", how="max")
    out = seen.where("reach is not null and best_so_far.max_txid > reach")
    return out.select("reach", (-F.col("best_so_far.neg_min")).alias("min_txid"), "best_so_far.max_txid", "best_so_far.level", "best_so_far.size_bytes", "best_so_far.created_at_ms")


#: Steps of a restore plan that the driver follows itself; longer tables are walked by joins.
LOCAL_STEPS = 50_000


def walk(steps: DataFrame, start: int, local: int = LOCAL_STEPS) -> DataFrame:
    """Reaches on the path from ``start`` along (reach -> max_txid).

    Two numbers a file, of which a catalog of up to ``local`` files gives the driver its path at once. Beyond that, jumps
    double in each round, so a plan of n files takes log2(n) rounds of equi-joins and the driver holds none of it.
    """
    spark = steps.sparkSession
    got = steps.select("reach", "max_txid").limit(local + 1).collect()
    if len(got) <= local:
        to, at, path = dict(map(tuple, got)), start, []
        while at is not None:
            path.append((at,))
            at = to.get(at)
        return spark.createDataFrame(path, "reach bigint")
    jump = steps.select(F.col("reach").alias("a"), F.col("max_txid").alias("b"))
    on = spark.createDataFrame([(start,)], "reach bigint")
    while True:
        nxt = on.join(jump, on.reach == jump.a).select(F.col("b").alias("reach"))
        on = on.union(nxt).distinct().checkpoint()
        twice = jump.alias("x").join(jump.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b").checkpoint()
        if twice.isEmpty():
            nxt = on.join(jump, on.reach == jump.a).select(F.col("b").alias("reach"))
            return on.union(nxt).distinct()
        jump = twice


def _planned(files: list[tuple], target: int) -> list[tuple]:
    """`restore_plan` of rows (level, min_txid, max_txid, size_bytes, created_at_ms) in one sweep over the files by their start."""
    usable = [f for f in files if not target or f[2] <= target]
    snaps = [f for f in usable if f[0] == SNAPSHOT_LEVEL]
    plan = [max(snaps, key=lambda f: (f[2], f[1]))] if snaps else []
    reach = plan[0][2] if plan else 0
    rest = sorted((f for f in usable if f[0] < SNAPSHOT_LEVEL), key=lambda f: f[1])
    better = lambda f: (f[2], -f[1], f[0], -f[4] if f[4] is not None else -(1 << 62), f[3])
    best, at = None, 0
    while not (target and reach >= target):
        while at < len(rest) and rest[at][1] <= reach + 1:
            best = rest[at] if best is None or better(rest[at]) > better(best) else best
            at += 1
        if best is None or best[2] <= reach:
            break
        plan.append(best)
        reach = best[2]
    if not plan or (target and reach < target):
        raise PlanError("TxNotAvailable")
    if not target and any(f[0] < SNAPSHOT_LEVEL and f[1] > reach + 1 for f in files):
        raise PlanError("NonContiguousPlan")
    return plan


def restore_plan(files: DataFrame, target: int = 0, max_files: int | None = None, local: int = LOCAL_STEPS) -> DataFrame:
    """The files to restore, in order of max_txid: newest snapshot up to the target, then furthest reach each time.

    target 0 means the latest; then a file that starts beyond a gap is an error, as are a target that is not reached and an
    empty plan. More than ``max_files`` steps are PlanCapacityExceeded. A catalog of up to ``local`` files, five numbers each,
    is planned by the driver in one job; a longer one by joins, of which the driver sees none.
    """
    out = _restore_plan(files, target, local)
    if max_files is not None and out.limit(max_files + 1).count() > max_files:
        raise PlanError("PlanCapacityExceeded")
    return out


def _restore_plan(files: DataFrame, target: int, local: int) -> DataFrame:
    spark = files.sparkSession
    scratch.set_checkpoint_dir(spark)
    pool = files.select("level", F.col("min_txid").cast("bigint").alias("min_txid"), F.col("max_txid").cast("bigint").alias("max_txid"), "size_bytes", F.col("created_at_ms").cast("bigint").alias("created_at_ms"))
    got = pool.limit(local + 1).collect()
    if len(got) <= local:
        rows = _planned([tuple(r) for r in got], target)
        return spark.createDataFrame(rows, pool.schema).orderBy("max_txid")
    pool = scratch.cut(pool, "catalog")  # five narrow columns, read several times
    usable = pool.where(F.col("max_txid") <= target) if target else pool
    snap = newest_snapshot(usable)
    row = snap.first()
    start = row.max_txid if row else 0
    out = snap
    rest = usable.where(F.col("level") < SNAPSHOT_LEVEL)
    if not (target and start >= target):
        reaches = rest.select(F.col("max_txid").alias("reach")).distinct().union(spark.createDataFrame([(start,)], "reach bigint")).distinct()
        steps = successors(rest, reaches).checkpoint()
        path = walk(steps, start, local)
        out = snap.unionByName(steps.join(path, "reach", "left_semi").select(*snap.columns))
    reached = out.agg(F.max("max_txid")).first()[0]
    if reached is None or (target and reached < target):
        raise PlanError("TxNotAvailable")
    if not target and not pool.where((F.col("level") < SNAPSHOT_LEVEL) & (F.col("min_txid") > reached + 1)).isEmpty():
        raise PlanError("NonContiguousPlan")
    return out.orderBy("max_txid")


def compaction_prefix(source: DataFrame, max_inputs: int, max_bytes: int) -> DataFrame:
    """The leading files of a listing that fit both budgets; the first that does not fit ends it."""
    w = Window.orderBy("min_txid", "max_txid")
    # No more rows than the budget of inputs are ever ordered in one task
    head = source.orderBy("min_txid", "max_txid").limit(max_inputs)
    return head.withColumn("running_bytes", F.sum("size_bytes").over(w)).where(F.col("running_bytes") <= max_bytes)


def batches(source: list[Row], max_inputs: int, max_bytes: int, most: int, min_files: int = 1, total_bytes: int = 1 << 63, more: bool = False) -> list[list[Row]]:
    """`compaction_prefix` after `compaction_prefix` of a listing's rows, in order: ``most`` batches of ``total_bytes`` at most.

    The first stands as it is; further ones are given only where all files follow one another and ``min_files`` are left. If
    there are ``more`` rows than the listing's, a last batch that might take some of them waits.
    """
    out: list[list[Row]] = []
    at = taken = 0
    while len(out) < most and at < len(source):
        end, size = at, 0
        while end < len(source) and end - at < max_inputs and size + source[end].size_bytes <= max_bytes:
            size += source[end].size_bytes
            end += 1
        if end == at:
            break
        if out:
            last = at - len(out[-1])  # where the batch before begins
            follows = all(b.min_txid == a.max_txid + 1 for a, b in zip(source[last : end - 1], source[last + 1 : end]))
            cut = more and end == len(source) and end - at < max_inputs
            if not follows or cut or len(source) - at < min_files or taken + size > total_bytes:
                break
        out.append(source[at:end])
        at, taken = end, taken + size
    return out


def compaction_plan(source: DataFrame, destination: DataFrame, max_inputs: int, max_bytes: int) -> tuple[DataFrame, int]:
    """(files to compact, txid the destination continues from). The first file must start exactly there."""
    if max_inputs < 1 or max_bytes < 1:
        raise PlanError("InvalidLevels")
    seek = (destination.agg(F.max("max_txid")).first()[0] or 0) + 1
    if seek > exprs.MAX_TXID:
        raise PlanError("CompactionNotAvailable")
    chosen = compaction_prefix(source, max_inputs, max_bytes)
    first = chosen.agg(F.min("min_txid")).first()[0]
    if first is not None and first != seek:
        raise PlanError("CompactionNotAvailable")
    return chosen, int(seek)


def retention(lower: DataFrame, upper: DataFrame, limit: int | None = None) -> DataFrame:
    """Lower files that lie within one upper file.

    A containment semi-join: of the upper files that start no later, the furthest end decides, so a running maximum replaces
    the range join.
    """
    ends = upper.groupBy("min_txid").agg(F.max("max_txid").alias("__end")).select(F.col("min_txid").alias("__at"), "__end", F.lit(None).cast("int").alias("__k"))
    asks = lower.select(F.col("min_txid").alias("__at"), F.lit(None).cast(ends.schema["__end"].dataType).alias("__end"), F.lit(1).alias("__k"), F.struct(*lower.columns).alias("__row"))
    seen = prefix.running(ends.withColumn("__row", F.lit(None).cast(asks.schema["__row"].dataType)).unionByName(asks), "__at", F.col("__end"), "__reach", how="max")
    out = seen.where((F.col("__k") == 1) & (F.col("__reach") >= F.col("__row.max_txid"))).select("__row.*")
    return out if limit is None else out.orderBy("min_txid", "max_txid").limit(limit)


def covered_snapshots(files: DataFrame, min_txid: int, max_txid: int) -> DataFrame:
    """Snapshots within an output range, but not the output itself."""
    s = files.where(F.col("level") == SNAPSHOT_LEVEL)
    same = (F.col("min_txid") == min_txid) & (F.col("max_txid") == max_txid)
    return s.where(~same & (F.col("min_txid") >= min_txid) & (F.col("max_txid") <= max_txid))


def source_after(source: DataFrame, covered: int) -> DataFrame:
    """A listing without its leading files that end at or before ``covered``; later ones stay even if they end before it."""
    first = source.where(F.col("max_txid") > covered).agg(F.min(F.struct("min_txid", "max_txid")).alias("__f"))
    return source.join(F.broadcast(first), F.struct("min_txid", "max_txid") >= F.col("__f")).drop("__f")


def batch_due(source: DataFrame, min_files: int) -> bool:
    n = max(min_files, 1)
    return source.limit(n).count() >= n
