"""Mixing sources to target weights, DataFrame operations only.

Words per source are aggregated; weights share out all words, a source stopping at CAP times its own. A source's rate is
its target over its size. Each document is emitted floor(rate) times, plus once more with the fraction as probability.

The extra copies of a source are one systematic draw, seeded by a hash of the source: its documents, in the order of size and
of a hash of their ids, are numbered from 0, and number r gets a copy if a whole number lies in (u + r * fraction,
u + (r + 1) * fraction], with u uniform in [0, 1). For each document that is a Bernoulli copy with the fraction as probability;
over a source the number of copies is within one of what is wanted, and so are the words but for the size of one document.
Numbers are found by a range sort, in which a source of any size spreads over tasks; no source is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelog.llm import common

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"


def size(text: str | Column) -> Column:
    """Words of a text; null: 0."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c.cast("string"), F.lit(common.WORD)), F.lit(0)).cast("long")


def _draw(value: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1), the same for a value on every run."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with rank (from 0) in code point order, null last, found per range partition: no task sees them all."""
    low = F.lit((1 << 33) - 1)
    dealt = common.cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    parts = dealt.groupBy("part").agg(F.count("*").alias("c"))  # one row per partition
    parts = parts.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    return dealt.join(parts, "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(low)).drop("part", "at", "before")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    A target is min(cap * size, level * weight) with the level at which targets sum to all words; the level is found by
    raising it until no further source is stopped, one aggregation each time.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = common.cut(_ranked(sources).select("source", "source_size", weight.cast("double").alias("weight")), "ranked")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        over = F.col("source_size") * F.lit(cap) < F.col("weight") * F.lit(level)
        held, weighs, n = ranked.agg(F.sum(F.when(over, F.col("source_size") * cap)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == stopped or not weighs:
            break
        level, stopped = (total - float(held or 0)) / weighs, n
    target = F.least((F.col("source_size") * cap).cast("double"), F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def extra(u: Column, rank: Column, fraction: Column) -> Column:
    """Whether the document numbered ``rank`` of its source gets one more copy."""
    return (F.floor(u + (rank + 1) * fraction) > F.floor(u + rank * fraction)).cast("long")


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: int, seed: str, rid: str | None = None) -> DataFrame:
    """(rid, doc_id, size, source_size, target, copies) for every row; rid is null if no column is named."""
    rid_col = F.lit(None).cast("long") if rid is None else F.col(rid)
    sized = common.cut(docs.select(rid_col.alias("rid"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size(text_col).alias("size")), "sized")
    goal = targets(sized, weights, cap).withColumnRenamed("source", "of")
    order = [F.col("source").asc_nulls_last(), "size", _draw(F.col("doc_id"), seed), "doc_id"]
    rows = common.cut(sized.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("at", 33))
    # A source lies in neighbouring parts of the sorted table: one row here for each source in each part.
    held = rows.groupBy("part", "source").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    held = held.withColumn("before", F.sum("c").over(Window.partitionBy("source").orderBy("part")) - F.col("c"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    held = held.join(goal, F.col("source").eqNullSafe(F.col("of"))).select(F.col("part").alias("p"), "of", "first", "before", "source_size", "target", rate.alias("rate"), _draw(F.col("of"), seed).alias("u"))
    out = rows.join(held, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("of")))
    rank = F.col("before") + F.col("at") - F.col("first")
    copies = F.floor("rate") + extra(F.col("u"), rank, F.col("rate") - F.floor("rate"))
    return out.select("rid", "doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of ``docs``.

    A null text has size 0; a null source is a source of its own, the last. Sources without words have target 0. Of rows that
    share doc_id, source and size, any may get the extra copies that fall to them. An empty table gives an empty result; other
    columns are ignored.
    """
    out = _planned(docs, id_col, text_col, source_col, WEIGHTS, CAP, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mixed rows: every row of ``docs``, all columns kept, as often as its copies say (not at all for none)."""
    rows, rid = common.with_rids(docs)
    taken = _planned(rows, id_col, text_col, source_col, WEIGHTS, CAP, seed, rid).where("copies > 0")
    key, times = common.fresh(rows, "__taken"), common.fresh(rows, "__copies")
    taken = taken.select(F.col("rid").alias(key), F.sequence(F.lit(1).cast("long"), F.col("copies")).alias(times))
    out = rows.join(taken, F.col(rid) == F.col(key)).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(times).alias(times))
    return out.drop(times)
