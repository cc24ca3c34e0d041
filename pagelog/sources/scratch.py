"""Tables that cut lineage, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where it is unset and the master is one local process does the library make its own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="pagelog-"))
    return _own_dir[0]


def path(spark: SparkSession, tag: str) -> str:
    """A name in the shared folder that nothing has."""
    return f"{shared_dir(spark)}/pagelog-{tag}-{uuid.uuid4().hex[:12]}"


def table(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder and read it back: a cut of the lineage that outlives executors."""
    at = path(df.sparkSession, tag)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def cut(df: DataFrame, tag: str) -> DataFrame:
    return table(df, tag)[0]


def drop(spark: SparkSession, at: str) -> None:
    """Delete a scratch table once nothing reads it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder, too, if the context knows no other."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
