"""Shared helpers: the shared scratch folder, lineage cuts, connected components."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelog.sources.scratch import cut, drop, path as scratch_path, shared_dir, table  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a run of characters that are none of the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Input files whose names the driver numbers at most.
FILES = 1_000_000


def _scans_files(df: DataFrame) -> bool:
    """Whether a table is one scan of files, each row of theirs once, always the same ones."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def with_rids(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a number for each row that is the same in every later scan, however files are split.

    Rows of one scan of files are numbered by file and place in it; any other table is stored with its numbers. Returns the
    table and the name of the added column, which none of ``docs`` has.
    """
    name, at, place = fresh(docs, "__rid"), fresh(docs, "__file"), fresh(docs, "__place")
    rows, files = docs, []
    if _scans_files(docs):
        try:
            rows = docs.select("*", F.col("_metadata.file_path").alias(at), F.col("_metadata.row_index").alias(place))
            files = [r[0] for r in rows.select(at).distinct().limit(FILES + 1).collect()]
        except AnalysisException:  # files of a format that has no row numbers
            files = []
    if not files or len(files) > FILES:
        return cut(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name
    known = fresh(docs, "__named")
    number = docs.sparkSession.createDataFrame([(f, k) for k, f in enumerate(sorted(files))], f"`{known}` string, `{name}` long")
    rows = rows.join(F.broadcast(number), F.col(at) == F.col(known))  # one row a file
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col(name) * F.lit(1 << 40) + F.col(place)).alias(name)), name


def lower_az(text: str | Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    ``lower`` alone equals it on texts that are all ASCII, and is much cheaper than ``translate`` there.
    """
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): one row (node, root) for every node, root = its smallest node.

    Alternating large-star and small-star steps. Each step is a pre-aggregated minimum per node and an equi-join back, so
    that a hub never meets in one task except as a skewed join, which adaptive execution splits. Every round is written to
    the shared folder. Self-loops keep their node; nulls are not allowed; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    edges, given = table(edges, "given")  # read several times, worked out once
    loops = cut(edges.where("a = b").select("a").distinct(), "loops")
    now, path = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    drop(spark, given)
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        # u > v always: large gives v > u >= m, and small relates v to the least m below it
        after, later = table(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        drop(spark, path)
        now, path = after, later
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    lone = loops.join(stars, loops.a == stars.node, "left_anti").select(F.col("a").alias("node"), F.col("a").alias("root"))
    return stars.union(roots).union(lone).distinct()
