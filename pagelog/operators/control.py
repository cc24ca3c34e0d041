"""The controller: capture, restore and maintenance of one replica tree of log files.

Files lie under ``<root>/ltx/<level>/<min>-<max>.ltx``. Every operation plans on the listing, decides on headers and page
numbers, and moves only the pages that it keeps. Objects are read back before they appear under their names; deletion comes
after what replaces the deleted files is there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pagelog.functions import codec, exprs
from pagelog.operators import catalog, merge
from pagelog.sources import logfiles, objects, scratch
from pagelog.sources.store import Files


#: Page numbers, 8 bytes each, that are broadcast at most.
LISTED = 4_000_000
#: Inputs, and bytes of them, that batches compacted together have at most, unless one batch alone has more.
WAVE, WAVE_BYTES = 4096, 1 << 36


class ControlError(RuntimeError):
    """An operation that cannot go on; the message is the error's name."""


@dataclass(frozen=True)
class Position:
    txid: int = 0
    post_apply_checksum: int = 0


@dataclass(frozen=True)
class Outcome:
    kind: str  # idle, reconciled, compacted
    level: int
    deleted: int = 0
    inputs: int = 0
    pages: int = 0
    covered: int = 0


class Counters(dict):
    """Counts of operations that stop at MOST; ``saturated`` tells for good that one has."""

    MOST = (1 << 64) - 1
    saturated = False

    def add(self, name: str, n: int = 1) -> None:
        now = self.get(name, 0)
        self.saturated = self.saturated or n > self.MOST - now
        self[name] = min(now + n, self.MOST)


@dataclass(frozen=True)
class Bounds:
    """What one operation may take: inputs and bytes of a compaction, files and pages of any chain, size of an image."""

    max_inputs: int = 256
    max_bytes: int = 1 << 30
    max_files: int = 100_000
    max_total_pages: int = 1 << 40
    max_image_pages: int = (1 << 32) - 1
    max_image_bytes: int = 1 << 48

    def __post_init__(self):
        if min(vars(self).values()) < 1 or self.max_files < self.max_inputs:
            raise ControlError("InvalidConfiguration")


@dataclass
class Chain:
    """A plan's files: headers on the driver (the bounds limit their number), page numbers in a stored table."""

    files: DataFrame  # of the binary reader, looked up once
    heads: list[Row]
    plan: DataFrame  # key, input_ordinal, version
    numbers: DataFrame  # input_ordinal, page_number
    stored: str

    @property
    def last(self) -> Row:
        return self.heads[-1]


@dataclass
class Controller:
    spark: SparkSession
    root: str
    ladder: catalog.Ladder = catalog.Ladder()
    limits: codec.Limits = codec.Limits()
    bounds: Bounds = Bounds()
    versions: dict[str, str] = field(default_factory=dict)  # format of files, by "level/name", that is not the current one
    state: str = "ready"
    last_ms: int | None = None
    counters: Counters = field(default_factory=lambda: Counters(sync=0, restore=0, maintain=0, failed=0))

    def __post_init__(self):
        self.files = Files(self.spark, self.root)

    # Startup

    def start(self, mode: str, expected: Position | None = None, image: DataFrame | None = None) -> tuple[Position, DataFrame | None]:
        """Take up work: 'require_empty' wants no file at all, 'verified_local' an image of pages (page_number, data) that equals
        the replica at its position, 'restore_latest' returns the replica's image. A replica that does not fit is refused."""
        if mode not in ("require_empty", "verified_local", "restore_latest"):
            raise ControlError("InvalidConfiguration")
        at = self.position()
        if mode == "require_empty":
            if at.txid:
                raise ControlError("ReplicaNotEmpty")
            return at, None
        at, remote = self.restore()
        if mode == "restore_latest":
            return at, remote
        if image is None or (expected is not None and expected.txid != at.txid):
            raise ControlError("PositionMismatch")
        digest = F.struct("page_number", F.sha2("data", 256).alias("digest"))
        differs = image.select(digest.alias("a")).join(remote.select(digest.alias("b")), F.col("a") == F.col("b"), "full_outer").where("a is null or b is null")
        if not differs.isEmpty():
            raise ControlError("DivergentHistory")
        return at, image

    # Listings

    def listing(self) -> DataFrame:
        """All files of the tree. The listing itself is done by Spark; only names and sizes move."""
        if not any(n.isdigit() for n in self.files.names("ltx")):
            return self.spark.createDataFrame([], "path string, level int, min_txid decimal(20,0), max_txid decimal(20,0), size_bytes bigint, created_at_ms bigint")
        out = logfiles.listing(self.spark, f"{self.root}/ltx")
        faults = catalog.listing_faults(out, self.limits.max_input_bytes)
        if not faults.isEmpty():
            raise ControlError("InvalidListing")
        return out

    def _admit(self, op: str) -> None:
        if self.state != "ready":
            raise ControlError("Poisoned" if self.state == "poisoned" else "Finished")
        self.counters.add(op)

    def _run(self, op: str, work, harmless: tuple[str, ...] = ()):
        self._admit(op)
        try:
            return work()
        except Exception as e:
            self.counters.add("failed")
            if str(e) not in harmless:
                self.state = "poisoned"
            raise

    def finish(self) -> None:
        self.state = "finished"

    # Capture

    def position(self) -> Position:
        got = self.listing().agg(F.max("max_txid")).first()[0]
        return Position(int(got or 0))

    def sync(self, pages: DataFrame, commit: int, page_size: int, now_ms: int, full: bool = False, wal: dict | None = None) -> Position:
        """Publish one transaction's pages (page_number, data) as the next level 0 file. ``full`` makes it hold every page.

        The first file is a snapshot and starts at transaction 1. Pages that the database grew by are always sent, zero if
        they are not given: otherwise a compaction over a shrink and a growth would bring old pages back. Times may not run
        backwards. ``wal`` tells the part of a write-ahead log that the file stands for: header fields by name.
        """

        def work() -> Position:
            if self.last_ms is not None and now_ms < self.last_ms:
                raise ControlError("TimestampRegression")
            self._fits(commit, page_size)
            txid = self.position().txid + 1
            head = {"flags": codec.NO_CHECKSUM, "page_size": page_size, "commit": commit, "min_txid": txid, "max_txid": txid, "timestamp_ms": now_ms} | (wal or {})
            lock = exprs.LOCK_BYTE // page_size + 1
            rows = pages.where((F.col("page_number") <= commit) & (F.col("page_number") != lock))
            known = 0 if full or txid == 1 else self._last_commit(txid - 1)
            if known < commit:  # only what the database grew by is filled up
                grown = merge.zero_fill(rows.where(F.col("page_number") > known), commit, page_size, {"data": F.lit(bytes(page_size))}, first=known + 1)
                rows = rows.where(F.col("page_number") <= known).unionByName(grown) if known else grown
            self._write([(head, None)], rows.withColumn("input_ordinal", F.lit(0).cast("bigint")), 0)
            self.last_ms = now_ms
            return Position(txid)

        return self._run("sync", work, ("TimestampRegression",))

    def _fits(self, commit: int, page_size: int) -> None:
        if commit > self.bounds.max_image_pages:
            raise ControlError("PageLimitExceeded")
        if commit * page_size > self.bounds.max_image_bytes:
            raise ControlError("OutputLimitExceeded")

    def _last_commit(self, txid: int) -> int:
        """Pages after a transaction, from the header of the lowest-level file that ends with it."""
        r = self.listing().where(F.col("max_txid") == txid).orderBy("level").first()
        key = "/".join(r.path.split("/")[-2:])
        return logfiles.read_files(self.spark, [r.path], self.versions.get(key, "v3"), self.limits, header_only=True).first().commit

    def _write(self, heads: list[tuple[dict, int | None]], pages: DataFrame, level: int) -> list[int]:
        """Publish a file for each head (fields by name, post checksum) from its pages (input_ordinal: the head's place in the list,
        page_number, data); the numbers of their pages."""
        schema = "input_ordinal bigint, " + ", ".join(f"{n} {'decimal(20,0)' if n in logfiles._WIDE else 'bigint'}" for n in logfiles._HEAD) + ", post_apply_checksum bigint"
        field = lambda head, n: Decimal(int(head.get(n, 0))) if n in logfiles._WIDE else int(head.get(n, 0))
        rows = [(k, *[field(head, n) for n in logfiles._HEAD], post) for k, (head, post) in enumerate(heads)]
        files = logfiles.encode_files(self.spark.createDataFrame(rows, schema), pages.select("input_ordinal", "page_number", "data"))
        # a row is an object, kept apart from the next step, so that a retried write does not lay it out again
        stored, at = scratch.table(files, "file")
        done = logfiles.publish(stored.select(F.lit(f"ltx/{level}").alias("folder"), "name", "content"), self.root).collect()
        counts = {r.input_ordinal: r.page_count for r in stored.select("input_ordinal", "page_count").collect()}
        scratch.drop(self.spark, at)
        if len(done) != len(heads) or sorted(counts) != list(range(len(heads))):
            raise ControlError("IndeterminateOutcome")
        return [counts[k] for k in range(len(heads))]

    # Restore

    def _chain(self, plan: DataFrame) -> Chain:
        """A plan's files, each decoded once and verified: identity, page size, checksum mode, continuity and bounds."""
        rows = plan.select("level", "min_txid", "max_txid").limit(self.bounds.max_files + 1).collect()
        if len(rows) > self.bounds.max_files:
            raise ControlError("PlanCapacityExceeded")
        chain, _, fault = self._chains([rows])
        if fault:
            raise fault
        return chain

    def _chains(self, plans: list[list[Row]]) -> tuple[Chain, list[list[Row]], ControlError | None]:
        """Plans' files (level, min_txid, max_txid) read together: (one chain of all, the heads of each plan, fault).

        Of plans before one that is not in order, the chain and the heads are returned with that one's fault.
        """
        keys = [[f"{r.level}/{int(r.min_txid):016x}-{int(r.max_txid):016x}.ltx" for r in sorted(plan, key=lambda r: r.max_txid)] for plan in plans]
        flat = [(k, p) for p, some in enumerate(keys) for k in some]
        paths = logfiles.named_files(self.spark, [f"{self.root}/ltx/{k}" for k, _ in flat])
        order = self.spark.createDataFrame([(k, n, self.versions.get(k, "v3"), p) for n, (k, p) in enumerate(flat)], "key string, input_ordinal bigint, version string, plan int")
        if self.bounds.max_total_pages < Bounds.max_total_pages:  # known from the indexes, before a page is decompressed
            counts = logfiles.keyed(logfiles.read_index(self.spark, paths, limits=self.limits).select("path"), F.broadcast(order)).groupBy("plan").count()
            over = counts.where(F.col("count") > self.bounds.max_total_pages).agg(F.min("plan")).first()[0]
            if over is not None:
                chain, heads, fault = self._chains(plans[:over]) if over else (None, [], None)
                return chain, heads, fault or ControlError("PageLimitExceeded")
        got, at = scratch.table(logfiles.read_chain(self.spark, paths, order, self.limits), "chain")
        heads, fault = [[] for _ in keys], None
        for r in sorted(got.drop("numbers").collect(), key=lambda r: r.input_ordinal):
            heads[flat[r.input_ordinal][1]].append(r)
        for n, (some, names) in enumerate(zip(heads, keys)):
            try:
                self._check_chain(some, names)
            except ControlError as e:
                heads, fault = heads[:n], e
                break
        return Chain(paths, [r for some in heads for r in some], order, got.select("input_ordinal", F.explode("numbers").alias("page_number")), at), heads, fault

    def _check_chain(self, heads: list[Row], keys: list[str]) -> None:
        for r, key in zip(heads, keys, strict=True):
            if r.status != "verified":
                raise ControlError(r.error)
            if f"{int(r.min_txid):016x}-{int(r.max_txid):016x}.ltx" != key.split("/")[1]:
                raise ControlError("ObjectIdentityMismatch")
        if len({r.page_size for r in heads}) > 1:
            raise ControlError("CompactionPageSizeMismatch")
        for a, b in zip(heads, heads[1:]):
            if b.min_txid != a.max_txid + 1:
                raise ControlError("NonContiguousTransition")
            if not b.flags & codec.NO_CHECKSUM and b.pre_apply_checksum != a.post_apply_checksum:
                raise ControlError("DivergentHistory")
        self._fits(heads[-1].commit, heads[-1].page_size)

    def _chosen(self, chain: Chain, left: DataFrame) -> DataFrame:
        """The payloads of chosen versions (page_number, input_ordinal).

        The lists go to the files by broadcast if the chain has LISTED pages at most, so that no file's bytes are shuffled.
        """
        lists = left.groupBy("input_ordinal").agg(F.collect_list("page_number").alias("numbers"))  # a file's own pages at most
        plan = chain.plan.join(lists, "input_ordinal")
        few = sum(r.page_count for r in chain.heads) <= LISTED
        return logfiles.read_chosen(self.spark, chain.files, F.broadcast(plan) if few else plan, self.limits)

    def verify(self, target: int = 0) -> Position:
        """Decode and check all files of a restore without making an image; the position that they reach."""

        def work() -> Position:
            chain = self._chain(catalog.restore_plan(self.listing().drop("path"), target, self.bounds.max_files))
            scratch.drop(self.spark, chain.stored)
            if chain.heads[0].min_txid != 1:
                raise ControlError("NonContiguousTransition")
            return Position(int(chain.last.max_txid), chain.last.post_apply_checksum)

        return self._run("restore", work, ("TxNotAvailable",))

    def restore(self, target: int = 0) -> tuple[Position, DataFrame]:
        """(position, pages 1..commit as (page_number, data)) as of a transaction, 0 for the latest.

        Pages come by sequential-apply semantics; pages never written are zero. A checked chain's image must match its
        checksum. Which versions stay is decided on page numbers; only their payloads are decoded again.
        """

        def work() -> tuple[Position, DataFrame]:
            chain = self._chain(catalog.restore_plan(self.listing().drop("path"), target, self.bounds.max_files))
            last, commits = chain.last, [r.commit for r in chain.heads]
            if chain.heads[0].min_txid != 1:
                raise ControlError("NonContiguousTransition")
            least, low = [], None
            for k in range(len(commits) - 1, -1, -1):
                least.append((k, low))
                low = commits[k] if low is None else min(low, commits[k])
            least = F.broadcast(self.spark.createDataFrame(least, "input_ordinal bigint, least_after bigint"))  # one row a file
            left = merge.alive(chain.numbers, least).where(F.col("page_number") <= last.commit)
            image = self._chosen(chain, left)
            if not last.flags & codec.NO_CHECKSUM:
                image, _ = scratch.table(image.select("page_number", "data", "page_checksum"), "image")  # read twice
                got = merge.database_checksum(image, page_size=last.page_size).first()[0]
                if got != last.post_apply_checksum:
                    raise ControlError("DatabaseChecksumMismatch")
            image, n = image.select("page_number", "data"), left.count()
            lock = exprs.LOCK_BYTE // last.page_size + 1
            if n < last.commit - (lock <= last.commit):
                gone = merge.missing(left, last.commit, last.page_size)
                image = image.unionByName(gone.withColumn("data", F.lit(bytes(last.page_size))))
            return Position(int(last.max_txid), last.post_apply_checksum), image

        return self._run("restore", work, ("TxNotAvailable",))

    # Maintenance

    def maintain(self, level: int, min_files: int = 1) -> Outcome:
        """One quantum of work towards a level: delete what it already covers, or compact the next batch into it.

        Deletion needs a verified chain over the covering files first. A batch smaller than ``min_files`` waits.
        """
        done = self._run("maintain", lambda: self._quanta(level, min_files, 1))
        return done[0] if done else Outcome("idle", level)

    def maintain_level(self, level: int, min_files: int = 1, most: int | None = None) -> list[Outcome]:
        """The quanta of `maintain` until it is idle, or ``most`` of them; those that follow one another are planned on one listing
        and read, written and deleted together. A batch at fault stops them: those before it are done, and its error is raised."""
        out: list[Outcome] = []
        while most is None or len(out) < most:
            done = self._run("maintain", lambda: self._quanta(level, min_files, WAVE if most is None else most - len(out)))
            if not done:
                break
            self.counters.add("maintain", len(done) - 1)
            out += done
        return out

    def _quanta(self, level: int, min_files: int, most: int) -> list[Outcome]:
        """Up to ``most`` quanta, none if there is nothing to do."""
        if level == 0 or level not in self.ladder:
            raise ControlError("InvalidDestinationLevel")
        below = self.ladder.previous(level)
        files = self.listing().drop("path")
        try:
            upper = catalog.restore_plan(files.where(F.col("level") >= level))
            covered = int(upper.agg(F.max("max_txid")).first()[0])
        except catalog.PlanError as e:
            if str(e) != "TxNotAvailable":
                raise
            upper, covered = files.where("false"), 0
            if most > 1 and not files.where(F.col("level") >= level).isEmpty():
                most = 1  # what a first batch joins to those files decides what comes next
        source = files.where(F.col("level") == below)
        if covered and (done := self._reconcile(files, source, upper, level, covered)):
            return [done]
        rest = catalog.source_after(source, covered)
        if not catalog.batch_due(rest, min_files):
            return []
        snap = catalog.newest_snapshot(files).first() if level == catalog.SNAPSHOT_LEVEL else None
        inputs, room = self.bounds.max_inputs, self.bounds.max_bytes
        if snap:
            inputs, room = inputs - 1, room - snap.size_bytes
        if inputs < 1 or room < 1:
            return []
        most = 1 if level == catalog.SNAPSHOT_LEVEL else most  # each snapshot is an input of the next
        n = max(inputs, min(WAVE, most * inputs))
        rows = rest.select("level", "min_txid", "max_txid", "size_bytes").orderBy("min_txid", "max_txid").limit(n).collect()
        batches = catalog.batches(rows, inputs, room, most, min_files, WAVE_BYTES, len(rows) == n)
        if not batches:
            return []
        if batches[0][0].min_txid != covered + 1:
            raise catalog.PlanError("CompactionNotAvailable")
        return self._compact([[*([snap] if snap else []), *batch] for batch in batches], level, files)

    def _compact(self, batches: list[list[Row]], level: int, files: DataFrame) -> list[Outcome]:
        """Each batch compacted into one file of a level: all are read, written and deleted together."""
        chain, chains, fault = self._chains(batches)
        heads, of = [], []
        for some in chains:
            first, last = some[0], some[-1]
            modes = {r.flags & codec.NO_CHECKSUM for r in some}
            if len(modes) > 1:
                fault = ControlError("CompactionChecksumModeMismatch")
                break
            of += [(r.input_ordinal, len(heads), last.commit) for r in some]
            head = {"flags": modes.pop(), "page_size": first.page_size, "commit": last.commit, "min_txid": first.min_txid, "max_txid": last.max_txid, "timestamp_ms": last.timestamp_ms, "pre_apply_checksum": first.pre_apply_checksum}
            heads.append((head, last.post_apply_checksum or None))
        if not heads:
            raise fault
        of = F.broadcast(self.spark.createDataFrame(of, "input_ordinal bigint, batch bigint, commit bigint"))  # one row a file
        newest = chain.numbers.join(of, "input_ordinal").where(F.col("page_number") <= F.col("commit")).groupBy("batch", "page_number").agg(F.max("input_ordinal").alias("input_ordinal"))
        pages = self._chosen(chain, newest.drop("batch")).join(of, "input_ordinal").select(F.col("batch").alias("input_ordinal"), "page_number", "data")
        written = self._write(heads, pages, level)
        scratch.drop(self.spark, chain.stored)
        done = batches[: len(heads)]
        names = [(r.level, r.min_txid, r.max_txid) for batch in done for r in batch if r.level != level]
        doomed = self.spark.createDataFrame(names, "level int, min_txid decimal(20,0), max_txid decimal(20,0)")
        if level == catalog.SNAPSHOT_LEVEL:
            doomed = doomed.unionByName(catalog.covered_snapshots(files, int(heads[0][0]["min_txid"]), int(heads[0][0]["max_txid"])).select(*doomed.columns))
        deleted = self._delete(doomed)
        if fault:
            raise fault
        gone = [deleted] if len(done) == 1 else [len(batch) for batch in done]
        return [Outcome("compacted", level, g, len(some), n, int(some[-1].max_txid)) for g, some, n in zip(gone, chains, written)]

    def maintain_batch(self, most: int = 64, min_files: int = 1) -> list[Outcome]:
        """Work on all levels from the lowest on, until nothing is due or ``most`` quanta are done."""
        out: list[Outcome] = []
        for level in [*range(1, self.ladder.top + 1), catalog.SNAPSHOT_LEVEL]:
            out += self.maintain_level(level, min_files, most - len(out))
        return out

    def _reconcile(self, files: DataFrame, source: DataFrame, upper: DataFrame, level: int, covered: int) -> Outcome | None:
        doomed = catalog.retention(source, upper)
        if level == catalog.SNAPSHOT_LEVEL:
            newest = catalog.newest_snapshot(files).first()
            doomed = doomed.unionByName(catalog.covered_snapshots(files, int(newest.min_txid), int(newest.max_txid)))
        if doomed.isEmpty():
            return None
        chain = self._chain(upper)
        scratch.drop(self.spark, chain.stored)
        if int(chain.last.max_txid) != covered:
            raise ControlError("ObjectIdentityMismatch")
        return Outcome("reconciled", level, self._delete(doomed), covered=covered)

    def _delete(self, doomed: DataFrame) -> int:
        """Delete objects in parallel; one that is gone already is no error."""
        root = self.root

        def run(batches):
            import pyarrow as pa

            store = objects.Objects(root)
            for b in batches:
                for name in b.column(0).to_pylist():
                    store.delete(name)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        # the rows come from a listing of the very files that go, so they are fixed first
        names, at = scratch.table(doomed.select(F.concat(F.lit("ltx/"), F.col("level"), F.lit("/"), exprs.file_name("min_txid", "max_txid")).alias("name")), "doomed")
        n = names.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0]
        scratch.drop(self.spark, at)
        return int(n or 0)
