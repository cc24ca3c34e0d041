"""Capture of a database and its write-ahead log into a replica, one file a sync.

A sync compares the log with where the last one ended and has one of three outcomes: nothing was committed since
(unchanged); the log goes on in the same segment (incremental: only frames behind the last end are read); or it does not, as
its salts changed, it is shorter than it was, or the frame before the end is another one (full: every page is sent).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelog.functions import exprs
from pagelog.operators import merge
from pagelog.operators.control import Controller, Position
from pagelog.sources import logfiles, wal

UNCHANGED, INCREMENTAL, FULL = "unchanged", "incremental", "full"


class CaptureError(RuntimeError):
    """What a capture refuses; the message is the error's name."""


@dataclass(frozen=True)
class Policy:
    """When a log should be checkpointed; 0 turns a threshold off."""

    max_bytes: int = 0
    max_frames: int = 0
    max_age_ms: int = 0

    def __post_init__(self):
        if min(self.max_bytes, self.max_frames, self.max_age_ms) < 0:
            raise CaptureError("InvalidConfiguration")


@dataclass(frozen=True)
class State:
    """Where the last sync ended."""

    position: Position = Position()
    salt: tuple[int, int] | None = None
    end: int = 0  # byte offset behind the last committed frame
    sums: tuple[int, int] | None = None  # of that frame
    commit: int = 0
    page_size: int = 0
    checkpoint_ms: int | None = None


@dataclass(frozen=True)
class Synced:
    kind: str
    state: State
    pages: int = 0
    reason: str | None = None  # why a sync was full
    checkpoint_due: bool = False


@dataclass
class Capture:
    controller: Controller
    database: str
    log: str
    policy: Policy = Policy()
    state: State = State()
    max_pages: int = (1 << 32) - 1

    def _classify(self, head) -> tuple[str, str | None]:
        s = self.state
        if s.salt is None:
            return FULL, "first"
        if head.page_size != s.page_size:
            return FULL, "page_size"
        if (head.salt_1, head.salt_2) != s.salt:
            return FULL, "salt"
        return INCREMENTAL, None

    def sync(self, now_ms: int, checkpoint_pending: bool = False) -> Synced:
        """Publish what was committed since the last sync; the state moves only after the file is published."""
        spark, s = self.controller.spark, self.state
        head = wal.read_head(spark, self.log)
        if head is None:  # no log yet: the database alone, once
            if s.salt is None and not s.position.txid:
                raise CaptureError("LogMissing")
            return Synced(UNCHANGED, s)
        kind, reason = self._classify(head)
        frames = None
        if kind == INCREMENTAL:
            first = wal.read_head(spark, self.log, s.end)
            if first is None or first.sums != s.sums:
                kind, reason = FULL, "previous_frame"
            else:
                frames = wal.read_frames(spark, self.log, s.end, self.max_pages)
        if kind == FULL:
            frames = wal.read_frames(spark, self.log, 0, self.max_pages)
        at = F.when(F.col("commit_pages") > 0, F.col("frame_index"))
        last, commit, seen = frames.agg(F.max(at), F.max_by("commit_pages", at), F.count("*")).first()
        if last is None:
            if kind == INCREMENTAL or (s.position.txid and reason == "salt"):
                # a restarted log without a commit still stands for the database that its checkpoint made
                return Synced(UNCHANGED, s)
        step = exprs.FRAME_HEADER + head.page_size
        size = head.page_size
        if last is None:
            raise CaptureError("NothingCommitted")
        end = exprs.WAL_HEADER + (last + 1) * step
        lock = exprs.LOCK_BYTE // size + 1
        mapped = merge.page_map(frames).select("page_number", "data")
        if kind == FULL:
            wanted = spark.range(1, commit + 1).withColumnRenamed("id", "page_number").where(F.col("page_number") != lock)
            base = logfiles.image_pages(spark, self.database, size).select("page_number", "data")
            pages = merge.backfill(wanted, mapped, base, ["data"]).withColumn("data", F.coalesce("data", F.lit(bytes(size))))
        else:
            pages = mapped
            if commit > s.commit:  # grown pages are sent even if no frame behind the last end has them
                wanted = spark.range(s.commit + 1, commit + 1).withColumnRenamed("id", "page_number").where(F.col("page_number") != lock)
                whole = merge.page_map(wal.read_frames(spark, self.log, 0, self.max_pages)).select("page_number", "data")
                base = logfiles.image_pages(spark, self.database, size).select("page_number", "data")
                grown = merge.backfill(wanted, whole, base, ["data"]).join(mapped.select("page_number"), "page_number", "left_anti")
                pages = mapped.unionByName(grown.withColumn("data", F.coalesce("data", F.lit(bytes(size)))))
        start = exprs.WAL_HEADER if kind == FULL else s.end
        meta = {"wal_offset": start, "wal_size": end - start, "wal_salt_1": head.salt_1, "wal_salt_2": head.salt_2}
        behind = wal.read_head(spark, self.log, end)
        if behind is None:
            raise CaptureError("LogChanged")
        sums = behind.sums
        position = self.controller.sync(pages, int(commit), size, now_ms, full=kind == FULL, wal=meta)
        self.state = replace(s, position=position, salt=(head.salt_1, head.salt_2), end=end, sums=sums, commit=int(commit), page_size=size, checkpoint_ms=now_ms if s.checkpoint_ms is None else s.checkpoint_ms)
        return Synced(kind, self.state, int(seen), reason, self._due(now_ms, end, int(last) + 1, checkpoint_pending))

    def _due(self, now_ms: int, wal_bytes: int, frames: int, pending: bool) -> bool:
        p, age = self.policy, now_ms - (self.state.checkpoint_ms if self.state.checkpoint_ms is not None else now_ms)
        return pending or any(most and value >= most for value, most in ((wal_bytes, p.max_bytes), (frames, p.max_frames), (age, p.max_age_ms)))

    def checkpointed(self, now_ms: int) -> None:
        """The caller checkpointed the log into the database; the next segment's first sync will be full."""
        if self.state.checkpoint_ms is not None and now_ms < self.state.checkpoint_ms:
            raise CaptureError("TimestampRegression")
        self.state = replace(self.state, checkpoint_ms=now_ms)


def sidecars(spark, database: str) -> list[str]:
    """Names of journals that lie beside a database file; a restore over it must find none."""
    from pagelog.sources.store import Files

    folder, _, name = database.rpartition("/")
    have = set(Files(spark, folder).names(""))
    return [n for n in (f"{name}-wal", f"{name}-shm", f"{name}-journal") if n in have]


def reject_sidecars(spark, database: str) -> None:
    if sidecars(spark, database):
        raise CaptureError("SidecarPresent")


def pending_pages(mapped: DataFrame, commit: int, state: State) -> DataFrame:
    """(page_number, fresh) that an incremental sync of a mapped log must carry, by the same rule as `Capture.sync`."""
    step = exprs.FRAME_HEADER + state.page_size
    return merge.captured_pages(mapped, commit, (state.end - exprs.WAL_HEADER) // step, state.commit, state.page_size)
