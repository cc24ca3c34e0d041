"""Exact duplicate groups by deterministic block naming, DataFrame operations only.

Normalised texts are cut into fixed-size blocks. Level 0 sorts the blocks into integer names; each further level names
adjacent pairs of names, until every document has one name. Names are ranks of whole contents, so equal names mean equal
texts: no hash decides equality. Blocks are sorted within many buckets of their content, so that one shuffle names them.
Blocks that many rows share are found first by a pre-aggregated count and named once; where a hash has only one content, the
hash tells the name by broadcast, so these rows carry no text through the shuffle and are spread evenly. Pairs and groups that
many rows share meet their names in the same way. COMMON bounds each of these broadcasts, narrow rows all; every other key
has 1/COMMON of all rows at most, or fewer than LEAST.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelog.llm import common

BLOCK = 8192
#: Keys that are joined by broadcast at most, and the rows that a key must have to be one of them.
COMMON, LEAST = 500_000, 256
_BUCKETS, _RANKS = 1 << 20, 1 << 43


def _named(bucket: str | Column, *order: str) -> Column:
    """An integer per content: bucket and rank of the content in its bucket, from 1."""
    w = Window.partitionBy(bucket).orderBy(*order)
    return F.col(bucket) * F.lit(_RANKS) + F.dense_rank().over(w)


def _blocks(docs: DataFrame, id_col: str, text_col: str, block: int, rid: Column) -> DataFrame:
    """(rid, doc_id, sha, n, pos, block, h): the blocks of each row's normalised text; an empty text has one empty block."""
    base = docs.select(rid.alias("rid"), F.col(id_col).cast("long").alias("doc_id"), common.lower_az(F.col(text_col).cast("string")).cast("binary").alias("bin"))
    n = F.greatest(F.ceil(F.octet_length("bin") / F.lit(block)), F.lit(1)).cast("int")
    base = base.select("rid", "doc_id", "bin", n.alias("n"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("bin"), i * block + 1, F.lit(block)))
    return base.select("rid", "doc_id", "n", F.when(F.lit(True), F.sha2("bin", 256)).alias("sha"), F.posexplode(cut).alias("pos", "block")).withColumn("h", F.xxhash64("block"))


def _bar(total: int | None) -> float:
    """Rows from which on a key is common: at most COMMON keys have so many."""
    return max(LEAST, (total or 0) / COMMON)


def _meet(rows: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """Stored ``rows`` joined with the row of their keys in the stored table ``named``, which counts them as c."""
    often = F.col("c") >= _bar(named.agg(F.sum("c")).first()[0])
    hot = F.broadcast(named.where(often).drop("c"))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(named.where(~often).drop("c"), keys))


def _common(blocks: DataFrame) -> DataFrame:
    """(kh, known): the names of common blocks by their hashes, of those hashes that stand for one content only."""
    total = Observation()
    counts = blocks.groupBy("h").agg(F.count("*").alias("c")).observe(total, F.sum("c").alias("n")).where(F.col("c") >= LEAST)
    counts, path = common.table(counts, "common")
    often = counts.where(F.col("c") >= _bar(total.get["n"])).select("h")
    if often.isEmpty():
        known = often
    else:
        contents = blocks.join(F.broadcast(often), "h", "left_semi").select("h", "block").distinct()
        known = contents.groupBy("h").agg(F.count("*").alias("k")).where("k = 1")
    known = known.withColumn("bucket", F.pmod("h", F.lit(_BUCKETS))).select(F.col("h").alias("kh"), (-_named("bucket", "h")).alias("known"))
    known = common.cut(known, "known")
    common.drop(blocks.sparkSession, path)
    return known


def _level0(docs: DataFrame, id_col: str, text_col: str, block: int, rid: Column) -> DataFrame:
    blocks = _blocks(docs, id_col, text_col, block, rid)
    blocks = blocks.join(F.broadcast(_common(blocks.select("h", "block"))), F.col("h") == F.col("kh"), "left")
    seen = F.col("known").isNotNull()
    bucket = F.when(seen, -1 - F.pmod(F.xxhash64("rid", "pos"), F.lit(_BUCKETS))).otherwise(F.pmod("h", F.lit(_BUCKETS)))
    first = F.col("pos") == 0
    blocks = blocks.select("rid", "n", "pos", "known", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"), bucket.alias("bucket"), F.when(~seen, F.col("block")).alias("block"))
    return blocks.withColumn("name", F.coalesce("known", _named("bucket", "block"))).select("rid", "n", "pos", "name", "doc_id", "sha")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, rid: Column | None = None) -> DataFrame:
    """(rid, doc_id, sha, n, name) per row: equal (n, name) if and only if the normalised texts are equal.

    rid is monotonically_increasing_id() over ``docs`` if not given; to join by rid, give a stored column.
    """
    rid = F.monotonically_increasing_id() if rid is None else rid
    level = common.cut(_level0(docs, id_col, text_col, block, rid), "level0")
    heads = level.where("pos = 0").select("rid", "doc_id", "sha", "n", "name")
    most = level.agg(F.max("n")).first()[0] or 1
    if most == 1:
        return heads
    now, done = level.where("n > 1").select("rid", F.col("n").alias("c"), "pos", "name"), None
    while most > 1:
        # 0 names nothing at any level: it stands for a missing right half
        pairs = now.groupBy("rid", "c", F.expr("pos div 2").cast("int").alias("pos")).agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(0).cast("long")).alias("b"))
        pairs = common.cut(pairs, "pairs")
        names = pairs.groupBy("a", "b").agg(F.count("*").alias("c")).withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(_BUCKETS)))
        names = common.cut(names.withColumn("name", _named("bucket", "a", "b")).drop("bucket"), "names")
        now = common.cut(_meet(pairs.withColumnRenamed("c", "m"), names, ["a", "b"]).withColumnRenamed("m", "c").select("rid", F.expr("(c + 1) div 2").cast("int").alias("c"), "pos", "name"), "level")
        ended = now.where("c = 1").select("rid", F.col("name").alias("last"))
        done = ended if done is None else done.union(ended)
        now = now.where("c > 1")
        most = (most + 1) // 2
    return heads.join(done, "rid", "left").select("rid", "doc_id", "sha", "n", F.coalesce("last", "name").alias("name"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, rid: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; A-Z count as a-z. Of equal texts the row with the largest doc_id stays (a null doc_id is
    below all others); of rows that also share the doc_id, one stays. An empty table gives an empty result; other columns
    are ignored.
    """
    ids = common.cut(identities(docs, id_col, text_col, block, rid), "ids")
    groups = common.cut(ids.groupBy("n", "name").agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("group_size")), "groups")
    rows = _meet(ids, groups.withColumn("c", F.col("group_size")), ["n", "name"])
    return rows.select("rid", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; odd rows as in `exact_groups`."""
    docs, rid = common.with_rids(docs)
    key = common.fresh(docs, "__kept")
    kept = exact_groups(docs, id_col, text_col, block, F.col(rid)).where("kept").select(F.col("rid").alias(key))
    return docs.join(kept, F.col(rid) == F.col(key), "left_semi").drop(rid)
