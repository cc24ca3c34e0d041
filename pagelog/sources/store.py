"""A versioned store of images: immutable generations and a commit log.

Generation n is a Parquet directory of a name that no other writer has; it exists for readers only once entry n of the log
names it. Entries are created, never replaced, so of two writers of the same number one fails and neither touches the other's
data. Each entry carries a checksum of its fields. Readers that need a generation for long hold a lease on it, which keeps
`expire` away. A generation may be a layer over earlier ones: changed pages only, so that publishing costs what changed; every
LAYERS generations a whole image is due. What a crash leaves behind is a directory that no entry names, which recovery removes. All files go through
Hadoop's file systems, so any store that Spark reaches will do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelog.functions import checksums


#: Layers that an image is read from at most.
LAYERS = 16


class StoreError(RuntimeError):
    """What the store refuses; the message is the error's name."""


@dataclass(frozen=True)
class Entry:
    generation: int
    txid: int
    checksum: int
    page_size: int
    commit: int
    batch: int | None = None
    state: dict = field(default_factory=dict)
    directory: str = ""
    #: Of an image in layers: [directory, pages above this number were wiped beneath it], the whole image first, this one last.
    layers: list = field(default_factory=list)

    def text(self) -> str:
        body = json.dumps(asdict(self), sort_keys=True)
        return json.dumps({"entry": body, "crc64": f"{checksums.crc64(body.encode()):016x}"})

    @classmethod
    def parse(cls, text: str) -> Entry:
        got = json.loads(text)
        if f"{checksums.crc64(got['entry'].encode()):016x}" != got["crc64"]:
            raise ValueError("checksum")
        return cls(**json.loads(got["entry"]))


class Files:
    """The few file-system calls that the log needs, through the JVM."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str) -> None:
        """Write a whole new file, or fail. The name is claimed by creating a directory of its own beside it, which of two
        writers one can; the text is written aside and renamed, so no reader sees a part of it."""
        part, claim = f"{name}.{uuid.uuid4().hex[:8]}.part", f"{name}.claim"
        out = self.fs.create(self._path(part), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self.fs.exists(self._path(name)):
                raise StoreError("ObjectExists")
            try:
                self.fs.create(self._path(claim), False).close()  # create without overwriting: fails for the second
            except Exception:
                raise StoreError("ObjectExists") from None
            if self.fs.exists(self._path(name)) or not self.fs.rename(self._path(part), self._path(name)):
                raise StoreError("ObjectExists")
        except StoreError:
            self.fs.delete(self._path(part), False)
            raise
        self.fs.delete(self._path(claim), False)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, name: str) -> list[str]:
        p = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class ImageStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.root = spark, Files(spark, root), root.rstrip("/")

    def entries(self) -> list[int]:
        return [int(n[:20]) for n in self.files.names("log") if n.endswith(".json") and n[:20].isdigit()]

    def entry(self, generation: int) -> Entry:
        try:
            return Entry.parse(self.files.read(f"log/{generation:020d}.json"))
        except (ValueError, TypeError, KeyError):
            raise StoreError("ManifestCorrupt") from None

    def current(self) -> Entry | None:
        """The last committed entry; None for a store that holds none."""
        known = self.entries()
        return self.entry(known[-1]) if known else None

    def read(self, generation: int | None = None) -> DataFrame:
        """Pages as of a generation, or of the current one: an immutable directory, whatever is published meanwhile."""
        e = self.current() if generation is None else self.entry(generation)
        if e is None:
            raise StoreError("DatabaseMissing")
        return self._image(e)

    def _image(self, e: Entry) -> DataFrame:
        if len(e.layers) < 2:
            return self.spark.read.parquet(f"{self.root}/{e.directory}")
        from pagelog.operators import merge

        parts, least, low = [], [], None
        for k, (directory, above) in reversed(list(enumerate(e.layers))):
            least.append((k, low))
            low = above if low is None else min(low, above) if above is not None else low
            parts.append(self.spark.read.parquet(f"{self.root}/{directory}").withColumn("__layer", F.lit(k).cast("bigint")))
        rows = reduce(DataFrame.unionByName, parts)
        least = F.broadcast(self.spark.createDataFrame(least, "__layer bigint, least_after bigint"))  # LAYERS rows at most
        left = merge.alive(rows.select("page_number", "__layer"), least, "__layer")
        return rows.join(left, ["page_number", "__layer"]).select(*[c for c in rows.columns if c != "__layer"])

    def room(self) -> bool:
        """Whether the next generation may be a layer."""
        last = self.current()
        return last is not None and max(len(last.layers), 1) < LAYERS

    def publish(self, pages: DataFrame, txid: int, checksum: int, page_size: int, commit: int, batch: int | None = None, state: dict | None = None, above: int | None = None) -> Entry:
        """Write the next generation and commit it. A batch that was already committed is not written again.

        With ``above``, ``pages`` are a layer: they replace the current image's pages of the same numbers, after those above
        this number were wiped. Without it, they are the whole image.
        """
        last = self.current()
        if batch is not None and last is not None and last.batch is not None and last.batch >= batch:
            return last
        n = last.generation + 1 if last else 0
        directory = f"gen={n}-{uuid.uuid4().hex[:12]}"
        pages.write.parquet(f"{self.root}/{directory}")
        layers = [[directory, None]]
        if above is not None:
            if last is None:
                raise StoreError("DatabaseMissing")
            layers = [*(last.layers or [[last.directory, None]]), [directory, above]]
        e = Entry(n, txid, checksum, page_size, commit, batch, state or {}, directory, layers)
        try:
            self.files.create(f"log/{n:020d}.json", e.text())
        except StoreError:
            self.files.delete(directory)  # another writer was first; this one's data were never visible
            raise
        return e

    def begin(self, page_size: int) -> Staged:
        return Staged(self, page_size)

    def acquire(self, generation: int | None = None) -> Lease:
        """A hold on a generation, by default the current one; while it lasts, `expire` leaves its directory alone."""
        e = self.current() if generation is None else self.entry(generation)
        if e is None:
            raise StoreError("DatabaseMissing")
        lease = Lease(self, e, f"lease/{e.generation:020d}.{uuid.uuid4().hex[:12]}")
        self.files.create(lease.name, "")
        if e.directory not in self.files.names(""):
            lease.release()
            raise StoreError("GenerationExpired")
        return lease

    def leased(self) -> set[int]:
        return {int(n[:20]) for n in self.files.names("lease") if n[:20].isdigit()}

    def recover(self) -> list[str]:
        """Remove what no entry stands for: directories of uncommitted generations and unfinished files. Returns their names."""
        gone = [name for name, n, of in self._directories() if name != of]
        gone += [f"{d}/{n}" for d in ("log", "lease") for n in self.files.names(d) if n.endswith((".part", ".claim"))]
        for n in gone:
            self.files.delete(n)
        return gone

    def expire(self, keep: int = 1) -> list[int]:
        """Drop the directories of all but the newest and the leased generations; their entries stay as history."""
        known, old = self.entries(), []
        kept = [self.entry(n) for n in {*(known[-keep:] if keep else []), *(self.leased() & set(known))}]
        needed = {name for e in kept for name, _ in e.layers or [[e.directory, None]]}
        for name, n, of in self._directories():
            if name == of and name not in needed:
                self.files.delete(name)
                old.append(n)
        return sorted(old)

    def _directories(self) -> list[tuple[str, int | None, str | None]]:
        """(name, number, directory that the number's entry names) of each generation's directory."""
        known, out = set(self.entries()), []
        for name in self.files.names(""):
            if name.startswith("gen="):
                n = name[4:].split("-")[0]
                n = int(n) if n.isdigit() else None
                out.append((name, n, self.entry(n).directory if n in known else None))
        return out


@dataclass
class Lease:
    store: ImageStore
    entry: Entry
    name: str

    def read(self) -> DataFrame:
        return self.store.read(self.entry.generation)

    def release(self) -> None:
        self.store.files.delete(self.name)


class Staged:
    """A staged apply: pages are laid over the current image, checked, and published as one generation, or not at all."""

    def __init__(self, store: ImageStore, page_size: int):
        self.store, self.page_size, self.state = store, page_size, "open"
        self.base = store.current()
        if self.base is not None and self.base.page_size != page_size:
            raise StoreError("PageSizeMismatch")
        self.image: DataFrame | None = store.read(self.base.generation) if self.base else None
        self.txid, self.commit = (self.base.txid, self.base.commit) if self.base else (0, 0)

    def stage(self, pages: DataFrame, min_txid: int, max_txid: int, commit: int, snapshot: bool = False) -> None:
        """Lay one transition's pages (page_number, data, page_checksum) over the image. It must continue the last one; a
        snapshot may replace the image whatever that was."""
        from pagelog.operators import merge

        if self.state != "open":
            raise StoreError("SessionClosed")
        if not (snapshot and min_txid == 1) and min_txid != self.txid + 1:
            raise StoreError("NonContiguousTransition")
        cols = [c for c in pages.columns if c != "page_number"]
        base = pages.limit(0) if snapshot or self.image is None else self.image
        self.image = merge.apply_overlay(base, pages, commit, cols)
        self.txid, self.commit = max_txid, commit

    def publish(self, checksum: int | None = None) -> Entry:
        """Verify the image against a database checksum, if one is given, and commit it. A failed check aborts.

        If the commit's outcome is unknown, the session is indeterminate: `settle` reads the log back.
        """
        from pagelog.operators import merge

        if self.state != "open" or self.image is None:
            raise StoreError("SessionClosed")
        if checksum is not None:
            got = merge.database_checksum(self.image, page_size=self.page_size).first()[0]
            if got != checksum:
                self.state = "aborted"
                raise StoreError("DatabaseChecksumMismatch")
        self.state = "indeterminate"
        self.entry = self.store.publish(self.image, self.txid, checksum or 0, self.page_size, self.commit)
        self.state = "published"
        return self.entry

    def settle(self) -> Entry | None:
        """After an indeterminate publication: the entry if it is in the log, else None and the session is aborted."""
        now = self.store.current()
        if now is not None and now.txid == self.txid and (self.base is None or now.generation > self.base.generation):
            self.state = "published"
            return now
        self.abort()
        return None

    def abort(self) -> None:
        if self.state in ("open", "indeterminate"):
            self.state, self.image = "aborted", None
