"""Log files as DataFrames: listing, headers, pages, verdicts; and writing them.

Spark's binary reader fetches whole objects from any store it can reach, and lists them without opening them where no
content is asked for. Decoding runs in Arrow batches beside the scan, one row per page. A file that fails gives its verdict, and
an error where its pages are asked for. Writing compresses and sums pages in parallel; only compressed pages meet in the task
that lays a file out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelog.functions import codec, exprs

_HEAD = [f.name for f in fields(codec.Header)]
_WIDE = {"min_txid", "max_txid", "node_id"}  # unsigned 64-bit numbers
FILES = (
    "path string, level int, size_bytes bigint, flags bigint, page_size int, commit bigint, min_txid decimal(20,0), max_txid decimal(20,0), "
    "timestamp_ms bigint, pre_apply_checksum bigint, wal_offset bigint, wal_size bigint, wal_salt_1 bigint, wal_salt_2 bigint, "
    "node_id decimal(20,0), post_apply_checksum bigint, file_checksum bigint, page_count bigint, status string, error string"
)
PAGES = "path string, page_number bigint, flags int, data binary, frame_offset_bytes bigint, frame_size_bytes bigint, page_checksum bigint"


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _scan(spark: SparkSession, path: str, glob: str = "*.ltx") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, level, min_txid, max_txid, size_bytes, created_at_ms) of the files under ``path``, by name only: no file is opened.

    Names of another form are no files of ours. The level is the name of the folder.
    """
    rows = _scan(spark, path).select("path", F.col("length").alias("size_bytes"), F.element_at(F.split("path", "/"), -1).alias("name"), F.element_at(F.split("path", "/"), -2).alias("dir"))
    rows = rows.withColumn("id", exprs.parse_file_name("name")).where(F.col("id").isNotNull() & F.col("dir").rlike("^(0{3})?[0-9]$"))
    return rows.select("path", F.col("dir").cast("int").alias("level"), F.col("id.min_txid").alias("min_txid"), F.col("id.max_txid").alias("max_txid"), "size_bytes", F.lit(None).cast("bigint").alias("created_at_ms"))


def _verdict(path: str, data: bytes | None, version: str, limits: codec.Limits, header_only: bool, size: int | None = None) -> tuple[dict, codec.LogFile | None]:
    row = dict.fromkeys(["flags", *_HEAD, "post_apply_checksum", "file_checksum", "page_count", "error", "numbers"])
    row |= {"path": path, "size_bytes": len(data) if size is None else size, "status": "verified"}
    parts = path.rsplit("/", 2)
    row["level"] = int(parts[1]) if len(parts) == 3 and parts[1].isdigit() and len(parts[1]) in (1, 4) else None
    if data is None:  # too long to be read
        return row | {"status": "failed", "error": "InputLimitExceeded"}, None
    try:
        f = codec.decode(data, version, limits, header_only)
    except codec.FormatError as e:
        return row | {"status": "failed", "error": str(e)}, None
    h = f.header
    row |= {k: getattr(h, k) for k in _HEAD} | {"pre_apply_checksum": _signed(h.pre_apply_checksum)}
    if header_only:
        row["status"] = "header"
    else:
        row |= {"post_apply_checksum": _signed(f.post_apply_checksum), "file_checksum": _signed(f.file_checksum), "page_count": len(f.pages), "numbers": f.numbers}
    return row, f


def _decimal(values: list) -> pa.Array:
    return pa.array(values, pa.decimal128(20, 0))


def _files(version: str, limits: codec.Limits, header_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"path": pa.string(), "status": pa.string(), "error": pa.string(), "level": pa.int32(), "page_size": pa.int32()}
        names = [c.split()[0] for c in FILES.replace("decimal(20,0)", "decimal").split(", ")]
        for b in batches:
            for path, size, content in zip(b.column(0), b.column(1).to_pylist(), b.column(2)):
                row, _ = _verdict(path.as_py(), content.as_py(), version, limits, header_only, size)
                yield pa.RecordBatch.from_arrays([_decimal([row[n]]) if n in _WIDE else pa.array([row[n]], types.get(n, pa.int64())) for n in names], names=names)

    return run


#: Tasks that look up the files of a long list of names at most: each name is one small request.
LOOKUPS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def named_files(spark: SparkSession, names: list[str]) -> DataFrame:
    """The files of a list of names, looked up once: read what is returned as often as needed."""
    before = spark.conf.get(LOOKUPS)
    spark.conf.set(LOOKUPS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.format("binaryFile").load(names)
    finally:
        spark.conf.set(LOOKUPS, before)


def _contents(spark: SparkSession, path: str | list[str] | DataFrame, limits: codec.Limits) -> DataFrame:
    """(path, length, content); the content of files beyond the limit is null, and they are not opened."""
    files = path if isinstance(path, DataFrame) else named_files(spark, path) if isinstance(path, list) else _scan(spark, path)
    fits = F.col("length") <= limits.max_input_bytes
    long = files.where(~fits).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return files.where(fits).select("path", "length", "content").union(long)


def read_files(spark: SparkSession, path: str | list[str], version: str = "v3", limits: codec.Limits = codec.Limits(), header_only: bool = False) -> DataFrame:
    """One verdict row per file. The version is told, not guessed. ``header_only`` checks headers and leaves pages alone."""
    return _contents(spark, path, limits).mapInArrow(_files(version, limits, header_only), FILES)


INDEX = "path string, entry bigint, page_number bigint, frame_offset_bytes bigint, frame_size_bytes bigint, error string"


def _indexed(version: str, limits: codec.Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(2)):
                rows, error = np.zeros((1, 3), np.int64), None
                try:
                    if not content.is_valid:
                        raise codec.FormatError("InputLimitExceeded")
                    rows = np.array(codec.read_index(content.as_py(), version, limits)[1], np.int64).reshape(-1, 3)
                except codec.FormatError as e:
                    error = str(e)
                n, none = len(rows), error is not None
                cols = [pa.nulls(n, pa.int64()) if none else pa.array(c) for c in (np.arange(n), *rows.T)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), *cols, pa.array([error] * n, pa.string())], names=[c.split()[0] for c in INDEX.split(", ")])

    return run


def read_index(spark: SparkSession, path: str | list[str] | DataFrame, version: str = "v3", limits: codec.Limits = codec.Limits()) -> DataFrame:
    """A row for each entry of each file's page index, found from the files' ends without decompressing a page.

    A file whose index cannot be read has one row with its error. A file without pages has no row.
    """
    return _contents(spark, path, limits).mapInArrow(_indexed(version, limits), INDEX)


_PAGE_NAMES = [c.split()[0] for c in PAGES.split(", ")]


def _page_batches(path: str, f: codec.LogFile, keep: set[int] | None = None) -> Iterator[pa.RecordBatch]:
    at = [k for k, n in enumerate(f.numbers) if keep is None or n in keep]
    sums = f.page_checksums().view(np.int64)
    for lo in range(0, len(at), 256):
        ks = at[lo : lo + 256]
        yield pa.RecordBatch.from_arrays([
            pa.array([path] * len(ks), pa.string()), pa.array([f.numbers[k] for k in ks], pa.int64()), pa.array([f.flags[k] for k in ks], pa.int32()), pa.array([f.pages[k] for k in ks], pa.binary()),
            pa.array([f.index[k][1] for k in ks], pa.int64()), pa.array([f.index[k][2] for k in ks], pa.int64()), pa.array(sums[ks]),
        ], names=_PAGE_NAMES)


def _pages(version: str, limits: codec.Limits, strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, content in zip(b.column(0), b.column(1).to_pylist(), b.column(2)):
                row, f = _verdict(path.as_py(), content.as_py(), version, limits, False, size)
                if f is not None:
                    yield from _page_batches(row["path"], f)
                elif strict:
                    raise codec.FormatError(f"{row['error']}: {row['path']}")

    return run


def read_pages(spark: SparkSession, path: str | list[str], version: str = "v3", limits: codec.Limits = codec.Limits(), strict: bool = True) -> DataFrame:
    """Pages of verified files, one row each. A file that fails raises; without ``strict`` it gives no page, and `read_files` tells why."""
    return _contents(spark, path, limits).mapInArrow(_pages(version, limits, strict), PAGES)


CHAIN = "input_ordinal bigint, numbers array<bigint>, " + FILES


def keyed(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Files with the row of ``plan`` (key: level directory and name) that names them."""
    parts = F.split("path", "/")
    return df.withColumn("key", F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))).join(plan, "key")


def _chained(limits: codec.Limits):
    names = [c.split()[0] for c in CHAIN.replace("decimal(20,0)", "decimal").split(", ")]
    types = {"path": pa.string(), "status": pa.string(), "error": pa.string(), "level": pa.int32(), "page_size": pa.int32(), "numbers": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, content, version, ordinal in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()):
                row, _ = _verdict(path, content.as_py(), version, limits, False, size)
                row["input_ordinal"] = ordinal
                yield pa.RecordBatch.from_arrays([_decimal([row[n]]) if n in _WIDE else pa.array([row[n]], types.get(n, pa.int64())) for n in names], names=names)

    return run


def read_chain(spark: SparkSession, paths: list[str] | DataFrame, plan: DataFrame, limits: codec.Limits = codec.Limits()) -> DataFrame:
    """Verdicts and page numbers of a plan's files, each decoded once; ``plan`` has (key, input_ordinal, version) of each file."""
    rows = keyed(_contents(spark, paths, limits), F.broadcast(plan))  # a plan, whose files its maker has bounded
    return rows.select("path", "length", "content", "version", "input_ordinal").mapInArrow(_chained(limits), CHAIN)


def _chosen(limits: codec.Limits):
    names = ["input_ordinal", *_PAGE_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, content, version, ordinal, numbers in zip(*(b.column(k).to_pylist() if k != 2 else b.column(k) for k in range(6))):
                row, f = _verdict(path, content.as_py(), version, limits, False, size)
                if f is None:
                    raise codec.FormatError(f"{row['error']}: {path}")
                for out in _page_batches(path, f, set(numbers)):
                    yield pa.RecordBatch.from_arrays([pa.array([ordinal] * out.num_rows, pa.int64()), *out.columns], names=names)

    return run


def read_chosen(spark: SparkSession, paths: list[str] | DataFrame, plan: DataFrame, limits: codec.Limits = codec.Limits()) -> DataFrame:
    """(input_ordinal, page columns) of the pages that ``plan`` (key, input_ordinal, version, numbers) asks of each file.

    Lists of numbers, one a file, meet the files' compressed bytes; pages are decoded where they stay, and none is shuffled.
    """
    rows = keyed(_contents(spark, paths, limits), plan)
    return rows.select("path", "length", "content", "version", "input_ordinal", "numbers").mapInArrow(_chosen(limits), "input_ordinal bigint, " + PAGES)


PRESSED = "input_ordinal bigint, page_number bigint, size int, block binary, sum bigint, page_checksum bigint"


def _pressed(compress: bool):
    names = [c.split()[0] for c in PRESSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([-1 if x is None else x for x in pa.compute.binary_length(b.column(2)).to_pylist()])
            for n in np.unique(size).tolist():  # one, unless files of different page sizes are written together
                some = b if len(size) and (size == n).all() else b.filter(pa.array(size == n))
                numbers = some.column(1).to_numpy()
                if n <= 0 or (numbers < 1).any():
                    raise codec.FormatError("InvalidPageDataSize" if n <= 0 else "InvalidPageNumber")
                col = some.column(2)
                offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset)
                rows = np.frombuffer(col.buffers()[2], np.uint8, int(offsets[-1]))[offsets[0] :].reshape(len(col), n)
                got = codec.press(numbers, rows, compress)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([n] * len(col), pa.int32()), pa.array(got.blocks, pa.binary()), pa.array(got.sums.view(np.int64)), pa.array(got.checksums.view(np.int64))], names=names)

    return run


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (file, page); a file's pages follow one another."""
    keys = ["input_ordinal", *_HEAD, "post_apply_checksum"]
    now, held = None, []

    def done() -> pa.RecordBatch:
        head = codec.Header(**dict(zip(_HEAD, (int(v) for v in now[1:-1]))) | {"pre_apply_checksum": int(now[1 + _HEAD.index("pre_apply_checksum")]) % (1 << 64)})
        known = None if now[-1] is None else now[-1] % (1 << 64)
        rows = pa.Table.from_batches(held).combine_chunks()
        numbers = rows["page_number"].to_numpy()
        if any(n != head.page_size for n in rows["size"].unique().to_pylist()):
            raise codec.FormatError("InvalidPageDataSize")
        # int64 columns are the bit patterns of unsigned sums
        whole = codec.Pressed(rows["block"].to_pylist(), rows["sum"].to_numpy().view(np.uint64), rows["page_checksum"].to_numpy().view(np.uint64))
        data = codec.assemble(head, numbers, whole, known)
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([f"{head.min_txid:016x}-{head.max_txid:016x}.ltx"]), pa.array([len(numbers)], pa.int64()), pa.array([data], pa.binary())], names=["input_ordinal", "name", "page_count", "content"])

    for b in batches:
        ordinals = b.column(0).to_numpy()
        cuts = np.flatnonzero(ordinals[1:] != ordinals[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            if lo == hi:
                continue
            part = b.slice(lo, hi - lo)
            key = tuple(part.column(part.schema.get_field_index(n))[0].as_py() for n in keys)
            if now is None or key[0] != now[0]:
                if now is not None:
                    yield done()
                now, held = key, []
            part = part.select(["page_number", "size", "block", "sum", "page_checksum"])
            held.append(part.filter(part.column(0).is_valid()))
    if now is not None:
        yield done()


def encode_files(headers: DataFrame, pages: DataFrame, compress: bool = True) -> DataFrame:
    """(input_ordinal, name, page_count, content): one encoded file per header row, with its pages of ``pages``
    (input_ordinal, page_number, data).

    Pages are compressed and summed where they are; compressed, they are dealt by file and sorted, and only one file's pages are
    held at a time. A file beyond `codec.MAX_FILE_BYTES` is OutputLimitExceeded.
    """
    heads = headers.select("input_ordinal", *[F.col(c) for c in _HEAD], "post_apply_checksum")
    pressed = pages.select(F.col("input_ordinal").cast("bigint").alias("input_ordinal"), F.col("page_number").cast("bigint").alias("page_number"), "data").mapInArrow(_pressed(compress), PRESSED)
    rows = heads.join(pressed, "input_ordinal", "left")
    rows = rows.repartition("input_ordinal").sortWithinPartitions("input_ordinal", "page_number")
    return rows.mapInArrow(_laid, "input_ordinal bigint, name string, page_count bigint, content binary")


def _published(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelog.sources import objects

        store = objects.Objects(root)
        for b in batches:
            out = []
            for folder, name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = content.as_buffer()
                out.append((store.uri(f"{folder}/{name}"), len(data), store.put(f"{folder}/{name}", data)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["path", "size_bytes", "outcome"])

    return run


def publish(objects: DataFrame, root: str) -> DataFrame:
    """Write rows (folder, name, content) as objects under a root that all executors share; (path, size_bytes, outcome).

    Each object is written beside its place, read back, and renamed into it, so readers never see a part of one. Writing the
    same object again changes nothing, so a retried task is harmless; other bytes under the same name are an error. Tasks write
    through `objects.Objects`, which tells the stores that it reaches.
    """
    return objects.select("folder", "name", "content").mapInArrow(_published(root), "path string, size_bytes bigint, outcome string")


def image_pages(spark: SparkSession, path: str, page_size: int) -> DataFrame:
    """(path, page_number, data) of database images: page n lies at (n - 1) * page_size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0), b.column(1)):
                data = content.as_buffer()
                if len(data) % page_size:
                    raise codec.FormatError("InvalidPageDataSize")
                n = len(data) // page_size
                for lo in range(0, n, 256):
                    ks = range(lo, min(lo + 256, n))
                    yield pa.RecordBatch.from_arrays([pa.array([p.as_py()] * len(ks)), pa.array([k + 1 for k in ks], pa.int64()), pa.array([data[k * page_size : (k + 1) * page_size].to_pybytes() for k in ks], pa.binary())], names=["path", "page_number", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, page_number bigint, data binary")


def write_image(pages: DataFrame, commit: int, page_size: int, path: str) -> None:
    """Write pages 1..commit as one database file at a local path, page by page; missing pages are zero. Published by rename."""
    import os

    part, at = f"{path}.part", 0
    with open(part, "wb") as f:
        for r in pages.where(F.col("page_number") <= commit).select("page_number", "data").orderBy("page_number").toLocalIterator():
            f.seek((r.page_number - 1) * page_size)
            f.write(r.data)
            at = r.page_number
        f.truncate(commit * page_size)
        f.flush()
        os.fsync(f.fileno())
    assert at <= commit
    os.replace(part, path)
