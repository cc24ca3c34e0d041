"""Write-ahead logs as frames.

A log is a 32-byte header and frames of a 24-byte header and one page. Each frame carries the header's salts and sums that
run on from the frame before, so a log is read in order; logs are independent of each other. Reading stops, without error,
at the first frame that is torn, has other salts or other sums.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagelog.functions import checksums as C

#: Fixed values of the format.
HEADER, FRAME = struct.Struct(">8I"), struct.Struct(">6I")
MAGIC_LE, MAGIC_BE, VERSION = 0x377F0682, 0x377F0683, 3007000
END, TORN, SALT, SUMS = "end_of_input", "truncated_frame", "salt_mismatch", "checksum_mismatch"

FRAMES = "path string, frame_index bigint, page_number bigint, commit_pages bigint, salt_1 bigint, salt_2 bigint, offset_bytes bigint, page_size int, data binary"
LOGS = "path string, page_size int, salt_1 bigint, salt_2 bigint, frames bigint, stop string, error string"


class WalError(ValueError):
    """A log that cannot be read; the message is the error's name."""


@dataclass(frozen=True)
class WalHeader:
    big_endian: bool
    page_size: int
    sequence: int
    salt_1: int
    salt_2: int
    sums: tuple[int, int]


def header(data: bytes) -> WalHeader:
    if len(data) < HEADER.size:
        raise WalError("TruncatedHeader")
    magic, version, page_size, sequence, salt_1, salt_2, s0, s1 = HEADER.unpack(data[: HEADER.size])
    if magic not in (MAGIC_LE, MAGIC_BE):
        raise WalError("InvalidMagic")
    if version != VERSION:
        raise WalError("UnsupportedVersion")
    if not (512 <= page_size <= 65536 and page_size & (page_size - 1) == 0):
        raise WalError("InvalidPageSize")
    if C.wal_sums(data[:24], magic == MAGIC_BE) != (s0, s1):
        raise WalError("HeaderChecksumMismatch")
    return WalHeader(magic == MAGIC_BE, page_size, sequence, salt_1, salt_2, (s0, s1))


class Frames:
    """Valid frames of a log from a frame boundary on: (index, page, commit, offset, page bytes); ``stop`` says why they end."""

    def __init__(self, data: bytes, offset: int = 0, max_pages: int = (1 << 32) - 1):
        self.data, self.head, self.stop, self.max_pages = data, header(data), "", max_pages
        step = FRAME.size + self.head.page_size
        self.index, self.sums = 0, self.head.sums
        if offset:
            if (offset - HEADER.size) % step or offset < HEADER.size + step or offset > len(data):
                raise WalError("InvalidOffset")
            self.index = (offset - HEADER.size) // step
            _, _, salt_1, salt_2, *sums = FRAME.unpack_from(data, offset - step)
            if (salt_1, salt_2) != (self.head.salt_1, self.head.salt_2):
                raise WalError("PreviousFrameMismatch")
            self.sums = tuple(sums)

    def __iter__(self) -> Iterator[tuple[int, int, int, int, bytes]]:
        h, step = self.head, FRAME.size + self.head.page_size
        while not self.stop:
            at = HEADER.size + self.index * step
            if at == len(self.data):
                self.stop = END
            elif at + step > len(self.data):
                self.stop = TORN
            else:
                page, commit, salt_1, salt_2, s0, s1 = FRAME.unpack_from(self.data, at)
                if (salt_1, salt_2) != (h.salt_1, h.salt_2):
                    self.stop = SALT
                    return
                body = self.data[at + FRAME.size : at + step]
                sums = C.wal_sums(self.data[at : at + 8] + body, h.big_endian, self.sums)
                if sums != (s0, s1):
                    self.stop = SUMS
                    return
                if not page:
                    raise WalError("InvalidPageNumber")
                if max(page, commit) > self.max_pages:
                    raise WalError("PageLimitExceeded")
                self.sums = sums
                self.index += 1
                yield self.index - 1, page, commit, at, body


def salts(data: bytes, until: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """Distinct salts of all whole frames in the order first seen, up to and with ``until``; sums are not looked at."""
    h = header(data)
    step = FRAME.size + h.page_size
    found = list(dict.fromkeys(FRAME.unpack_from(data, at)[2:4] for at in range(HEADER.size, len(data) - step + 1, step)))
    return found[: found.index(until) + 1] if until in found else found


def build(pages: list[tuple[int, int, bytes]], page_size: int, salt: tuple[int, int] = (1, 2), big_endian: bool = True, sequence: int = 0) -> bytes:
    """A log of frames (page, commit pages or 0, bytes)."""
    head = struct.pack(">6I", MAGIC_BE if big_endian else MAGIC_LE, VERSION, page_size, sequence, *salt)
    sums = C.wal_sums(head, big_endian)
    out = [head, struct.pack(">2I", *sums)]
    for page, commit, body in pages:
        lead = struct.pack(">2I", page, commit)
        sums = C.wal_sums(lead + body, big_endian, sums)
        out += [lead, struct.pack(">4I", *salt, *sums), body]
    return b"".join(out)


def _frames(offset: int, max_pages: int):
    names = [c.split()[0] for c in FRAMES.split(", ")]

    def batch(path: str, f: Frames, rows: list) -> pa.RecordBatch:
        n = len(rows)
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([
            pa.array([path] * n), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([f.head.salt_1] * n, pa.int64()), pa.array([f.head.salt_2] * n, pa.int64()),
            pa.array(cols[3], pa.int64()), pa.array([f.head.page_size] * n, pa.int32()), pa.array(cols[4], pa.binary()),
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                f, rows = Frames(content.as_py(), offset, max_pages), []
                for row in f:
                    rows.append(row)
                    if len(rows) == 256:
                        yield batch(path, f, rows)
                        rows = []
                if rows:
                    yield batch(path, f, rows)

    return run


def read_frames(spark: SparkSession, path: str, offset: int = 0, max_pages: int = (1 << 32) - 1) -> DataFrame:
    """Valid frames of every log under ``path``; from a byte offset on if given, which must be the end of a frame."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_frames(offset, max_pages), FRAMES)


def read_head(spark: SparkSession, path: str, offset: int = 0) -> WalHeader | None:
    """The header of one log; None if there is no log, or if the frame that should end at ``offset`` is not of its segment.

    With an offset, ``sums`` are those of the frame that ends there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                try:
                    f = Frames(content.as_py(), offset)
                    h = f.head
                    row = [int(h.big_endian), h.page_size, h.sequence, h.salt_1, h.salt_2, *f.sums, None]
                except WalError as e:
                    row = [None] * 7 + [str(e)]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if k == 7 else pa.int64()) for k, v in enumerate(row)], names=list("abcdefgh"))

    from pagelog.sources.store import Files

    folder, _, name = path.rpartition("/")
    if name not in Files(spark, folder).names(""):
        return None
    r = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"{c} bigint" for c in "abcdefg") + ", h string").first()
    if r.h in ("InvalidOffset", "PreviousFrameMismatch") and offset:
        return None
    if r.h:
        raise WalError(r.h)
    return WalHeader(bool(r.a), r.b, r.c, r.d, r.e, (r.f, r.g))


def _logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            try:
                f = Frames(content.as_py())
                n = sum(1 for _ in f)
                row = (path, f.head.page_size, f.head.salt_1, f.head.salt_2, n, f.stop, None)
            except WalError as e:
                row = (path, None, None, None, None, None, str(e))
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in LOGS.split(", ")])


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log: its header, how many frames are valid, and why they end."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_logs, LOGS)
