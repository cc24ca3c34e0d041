"""Running aggregates over a whole ordered table without gathering it in one task.

Rows fall into buckets of a dense order key. Each bucket is scanned on its own; one row per bucket is scanned in order to
carry what came before, and joined back. A bucket of WIDTH keys leaves one row in WIDTH for that small scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 1 << 16


def running(df: DataFrame, order: str, value: Column, out: str, how: str = "sum", width: int = WIDTH, exclusive: bool = False) -> DataFrame:
    """``df`` with ``out``: the running sum or max of ``value`` in the order of the integer column ``order``.

    ``exclusive`` leaves the row itself (and rows with the same key) out: 0 for a sum, null for a max, where none precede.
    """
    agg, both = (F.sum, lambda a, b: a + b) if how == "sum" else (F.max, F.greatest)
    bucket = F.floor(F.col(order) / F.lit(width)).cast("bigint")
    rows = df.withColumn("__b", bucket).withColumn("__v", value)
    base = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__b").agg(agg("__v").alias("__s")).select("__b", agg("__s").over(base).alias("__before"))
    to = -1 if exclusive else 0
    own = Window.partitionBy("__b").orderBy(order).rangeBetween(Window.unboundedPreceding, to)
    rows = rows.withColumn("__own", agg("__v").over(own)).join(before, "__b")
    if how == "sum":
        got = F.coalesce("__own", F.lit(0)) + F.coalesce("__before", F.lit(0))
    else:
        got = F.greatest("__own", "__before")  # skips nulls
    return rows.withColumn(out, got).drop("__b", "__v", "__own", "__before")
