"""SQL functions for what Column expressions cannot do: checksums and codecs, in Arrow batches.

`register` makes them known to a session by name; each can also be called as a Python function on columns. Text and number
forms (`exprs`) and the database checksum need no such function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from pagelog.functions import checksums, codec


def _each(values: pa.Array, work, kind: pa.DataType) -> pa.Array:
    return pa.array([None if v is None else work(v) for v in values.to_pylist()], kind)


@F.arrow_udf(LongType())
def crc64(data: pa.Array) -> pa.Array:
    """CRC-64 of bytes as a BIGINT bit pattern; null for null."""
    return _each(data, lambda v: np.uint64(checksums.crc64(v)).astype(np.int64), pa.int64())


@F.arrow_udf(LongType())
def page_checksum(number: pa.Array, data: pa.Array) -> pa.Array:
    """Flagged checksum of a page's number and bytes."""
    out = [None if n is None or v is None else np.uint64(checksums.page_checksum(n, v)).astype(np.int64) for n, v in zip(number.to_pylist(), data.to_pylist())]
    return pa.array(out, pa.int64())


@F.arrow_udf(BinaryType())
def uvarint(number: pa.Array) -> pa.Array:
    return _each(number, codec.uvarint, pa.binary())


@F.arrow_udf(LongType())
def read_uvarint(data: pa.Array) -> pa.Array:
    """The number that the bytes start with; malformed bytes are an error."""
    return _each(data, lambda v: codec.read_uvarint(v, 0)[0], pa.int64())


@F.arrow_udf(BinaryType())
def lz4_compress(data: pa.Array) -> pa.Array:
    """A raw LZ4 block."""
    return _each(data, codec.lz4_compress, pa.binary())


@F.arrow_udf(BinaryType())
def lz4_decompress(block: pa.Array, size: pa.Array) -> pa.Array:
    """The bytes of a raw LZ4 block that must have the given size."""
    return pa.array([None if b is None or n is None else codec.lz4_block(b, n) for b, n in zip(block.to_pylist(), size.to_pylist())], pa.binary())


@F.arrow_udf(BinaryType())
def lz4_literals(data: pa.Array) -> pa.Array:
    """A raw LZ4 block of literals only."""
    return _each(data, codec.lz4_literals, pa.binary())


FUNCTIONS = {"crc64": crc64, "page_checksum": page_checksum, "uvarint": uvarint, "read_uvarint": read_uvarint, "lz4_compress": lz4_compress, "lz4_decompress": lz4_decompress, "lz4_literals": lz4_literals}


def register(spark: SparkSession, prefix: str = "pagelog_") -> list[str]:
    """Register all functions for SQL; their names."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(prefix + name, f)
    return [prefix + n for n in FUNCTIONS]
