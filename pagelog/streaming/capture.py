"""Capture of a frame stream with Structured Streaming.

Frames (frame_index, page_number, commit_pages, payload columns) arrive in micro-batches. Each batch is cut at its last commit;
later frames wait, as rows of the store's pending directory, for the batch that commits them. Within a batch every commit
takes effect in its turn, so the image does not depend on how frames fall into batches. A batch is one generation of the
store, and its id stands in the commit log, so a batch that runs again after a failure changes nothing. A generation is a layer
of changed pages while the store has room for layers; the whole image is written only where it has none, or a segment starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pagelog.operators import merge, prefix
from pagelog.sources import scratch
from pagelog.sources.store import ImageStore


class StreamError(RuntimeError):
    """Why a stream cannot go on; the message is the error's name."""


def changed(frames: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """What the transactions of ``frames``, all of them committed, make of an image, one after the other: the pages
    (page_number, payload) that they leave, and one row (low): pages of the image above this number are wiped.

    A commit of fewer pages wipes those above it, whichever later commit grows the database again.
    """
    marked = prefix.running(frames, "frame_index", F.when(F.col("commit_pages") > 0, 1).otherwise(0).cast("bigint"), "input_ordinal", exclusive=True)
    heads = marked.where("commit_pages > 0").select("input_ordinal", F.col("commit_pages").alias("commit"))
    least = merge.least_commit_after(heads).join(heads, "input_ordinal").select("input_ordinal", F.least("least_after", "commit").alias("least"))
    newest = merge.newest_wins(marked.select("page_number", "frame_index", "input_ordinal"), "frame_index")
    left = newest.join(least, "input_ordinal").where("page_number <= least").select("page_number", "frame_index")
    return frames.join(left, ["page_number", "frame_index"]).select("page_number", *payload), frames.where("commit_pages > 0").agg(F.min("commit_pages").alias("low"))


def apply_frames(base: DataFrame, frames: DataFrame, payload: list[str]) -> DataFrame:
    """``base`` (page_number, payload) after the transactions of ``frames``."""
    delta, low = changed(frames, payload)
    kept = base.join(delta.select("page_number"), "page_number", "left_anti").join(F.broadcast(low), F.col("page_number") <= F.col("low")).drop("low")
    return kept.select("page_number", *payload).unionByName(delta)


def _fold(store: ImageStore, batch: DataFrame, number: int, page_size: int, salt: str | None, clock: str | None, snapshot: Callable[[], DataFrame] | None) -> None:
    last = store.current()
    if last is not None and last.batch is not None and last.batch >= number:
        return
    spark, state = batch.sparkSession, dict(last.state) if last else {}
    frames = batch
    if state.get("pending"):
        frames = frames.unionByName(spark.read.schema(batch.schema).parquet(f"{store.root}/{state['pending']}"))
    frames = frames.where(F.col("frame_index") > state.get("end", -1)).dropDuplicates(["frame_index"])
    frames, kept = scratch.table(frames, "frames")  # read several times
    payload = [c for c in batch.columns if c not in ("page_number", "commit_pages")]
    at = F.when(F.col("commit_pages") > 0, F.col("frame_index"))
    picks = [F.min("frame_index").alias("first"), F.max(at).alias("end"), F.max_by("commit_pages", at).alias("commit")]
    if clock:
        low, high = batch.agg(F.min(clock), F.max(clock)).first()
        if low is not None and state.get("clock") is not None and str(low) < state["clock"]:
            raise StreamError("TimestampRegression")
        state["clock"] = state.get("clock") if high is None else str(high)
    segments = sorted((frames.groupBy(F.col(salt).cast("string").alias("salt")) if salt else frames.groupBy(F.lit(None).cast("string").alias("salt"))).agg(*picks).collect(), key=lambda r: r.first)
    if not segments:
        return
    empty = spark.createDataFrame([], StructType([f for f in batch.schema if f.name in ("page_number", *payload)]))
    image = store.read() if last is not None else empty
    layer, commit, end, now, tail = store.room(), state.get("commit", 0), state.get("end", -1), state.get("salt"), None
    for seg in segments:
        own = frames.where(F.col(salt).cast("string").eqNullSafe(seg.salt)) if salt else frames
        if now is not None and seg.salt != now:
            # Frames of another segment do not continue this one; what the old one left uncommitted is void.
            if snapshot is None:
                raise StreamError("SegmentMissing")
            image, layer = snapshot().select("page_number", *payload), False
        now = seg.salt
        tail = own if seg.end is None else own.where(F.col("frame_index") > seg.end)
        if seg.end is not None:
            done = own.where(F.col("frame_index") <= seg.end)
            image = apply_frames(image, done, payload)
            commit, end = seg.commit, seg.end
    above = None
    if layer and len(segments) == 1:
        image, above = empty, (1 << 62)  # nothing committed: nothing changes
        if segments[0].end is not None:
            image, low = changed(done, payload)
            above = int(low.first()[0])
    pending = f"pending/{number:020d}"
    tail.write.mode("overwrite").parquet(f"{store.root}/{pending}")
    new = {"end": int(end), "commit": int(commit), "pending": pending, "salt": now, "clock": state.get("clock")}
    store.publish(image.select("page_number", *payload), number, 0, page_size, int(commit), batch=number, state=new, above=above)
    scratch.drop(spark, kept)


def start(frames: DataFrame, root: str, checkpoint: str, page_size: int = 4096, salt: str | None = None, clock: str | None = None, snapshot: Callable[[], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Keep the image of a frame stream in an `ImageStore`. ``trigger`` as for writeStream, e.g. availableNow=True.

    ``salt`` names a column that tells segments apart. Frames of a new segment do not continue the image: they are laid over
    the whole image that ``snapshot`` gives, the database as the log's restart left it; without it the query fails with
    SegmentMissing. ``clock`` names a column that may not run backwards from batch to batch.
    """
    spark: SparkSession = frames.sparkSession
    store = ImageStore(spark, root)
    store.recover()
    out = frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, n: _fold(store, b, n, page_size, salt, clock, snapshot))
    return (out.trigger(**trigger) if trigger else out).start()


def interval_counts(frames: DataFrame, ts: str, interval: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """(window, frames, pages_about) per epoch-aligned interval, for the ladder's schedule; late rows are kept up to ``late``.

    Frames are counted exactly. Distinct pages are estimated by a sketch, as streams keep no exact distinct counts.
    """
    return frames.withWatermark(ts, late).groupBy(F.window(ts, interval)).agg(F.count("*").alias("frames"), F.approx_count_distinct("page_number").alias("pages_about"))
