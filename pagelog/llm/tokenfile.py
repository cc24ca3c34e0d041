"""Token ids in seekable binary files.

A file is a row of zstandard frames. Each document is a frame of its own, so that a reader decompresses only the documents
it was asked for; the trailing seek table (the public seekable format: a skippable frame with sizes and XXH64 checksums of all
frames, then the frame count and a magic number) tells where each one starts. Before the table, a skippable frame holds the
file's number and the doc_ids. Ids are little-endian unsigned integers of 2 bytes where the vocabulary fits, else 4.

Spark's own text writer and binary reader move the bytes, so files can lie in any store that Spark reaches, and a lost
executor's files are written again by the usual commit protocol. The text writer ends each row with a separator; the
separator used is itself an empty skippable frame, so the file stays a valid zstandard stream. Hence a file ends with
one such frame after its seek table.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelog.llm import chunks, common

#: Fixed values of the zstandard formats.
SKIPPABLE, SKIPPABLE_INDEX, SKIPPABLE_TABLE, TABLE_MAGIC = 0x184D2A50, 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
#: An empty skippable frame: eight ASCII characters.
PAD = struct.pack("<II", SKIPPABLE, 0)
END_ID = 0
LEVEL = 3
#: Bytes of frames that are handed to the writer as one row.
ROW = 1 << 20
#: Rows of a file, the last one its tables; so a file holds about as many MiB, and no reader holds more.
ROWS = 64
#: Bytes of text that are encoded together, and words encoded as one text.
SLICE, JOIN = 1 << 22, 64


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Classes of bytes: letter, digit, space, other white space, mark, unknown; 0 goes on with the byte before.
_LETTER, _DIGIT, _BLANK, _WHITE, _MARK, _UNKNOWN = range(1, 7)


def _classes() -> np.ndarray:
    out = np.full(256, _UNKNOWN, np.uint8)
    out[0x21:0x7F] = _MARK
    out[0x30:0x3A] = _DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = out[0xC3:0xC9] = _LETTER  # U+00C0 to U+023F, but for two
    out[0x27] = _UNKNOWN  # an apostrophe may start a contraction
    out[0x80:0xC0] = 0
    out[0x20] = _BLANK
    out[0x09:0x0E] = _WHITE
    return out


_CLASS = _classes().tobytes()
#: Control characters, and what else may be white space to someone.
_ODD = r"[\x00-\x08\x0e-\x1f\x7f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern surely starts a new word in texts laid end to end; each text starts one.

    A word is a run of letters, digits or marks with a space before it if there is one; of a run of white space, the last
    character stands apart from the rest if something follows. Runs without white space that hold a byte of unknown class
    stay whole, so what lies between two cuts may be several words. No text may match _ODD.
    """
    n = len(data)
    kind = np.frombuffer(bytearray(data.tobytes().translate(_CLASS)), np.uint8)
    for at in np.flatnonzero((data == 0xC3) & np.isin(data.take(np.arange(1, n + 1), mode="clip"), (0x97, 0xB7))) if (data == 0xC3).any() else ():
        kind[at] = _UNKNOWN  # the signs for times and division
    rest = np.flatnonzero(kind == 0)
    for _ in range(3):
        rest = rest[kind[rest] == 0]
        kind[rest] = kind[rest - 1]
    white = (kind == _BLANK) | (kind == _WHITE)
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    out = np.empty(n, bool)
    out[0] = True
    # another class starts a word, but for what follows a space
    out[1:] = (kind[1:] != kind[:-1]) & ((kind[:-1] != _BLANK) | white[1:])
    # within white space only its last character may, where text follows
    inner = np.flatnonzero(white[1:] & white[:-1]) + 1
    ends = np.minimum(inner + 1, n - 1)
    out[inner] = ~white[ends] & ~first[inner + 1]
    out |= first[:n]
    unknown = np.flatnonzero(kind == _UNKNOWN)
    if len(unknown):
        solid = ~white
        begin = solid.copy()
        begin[1:] &= white[:-1] | first[1:n]
        stop = solid.copy()
        stop[:-1] &= white[1:] | first[1:n]
        begin, stop = np.flatnonzero(begin), np.flatnonzero(stop)
        held = np.unique(np.searchsorted(begin, unknown, "right") - 1)
        mark = np.zeros(n + 1, np.int8)
        mark[begin[held] + 1] += 1
        mark[stop[held] + 1] -= 1
        out &= np.cumsum(mark[:n], dtype=np.int8) == 0
    return out


class Encoder:
    """Ids of whole texts as the tokenizers library gives them without added special tokens.

    Texts are cut where the byte-level pattern surely cuts them, as whole arrays of bytes; each distinct word goes through
    the library once per table, and ids are joined back by position. Texts that hold a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tk = Tokenizer.from_file(path)
        spec = json.loads(self.tk.to_str())
        pre = spec.get("pre_tokenizer") or {}
        #: Cutting is exact for this pre-tokenizer and no other step on the text.
        self.cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        size = self.tk.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.spaces = np.array([(self.tk.id_to_token(i) or "")[:1] == "Ġ" for i in range(size)])
        # The same vocabulary and merges cut at spaces only, for words that the pattern would leave whole.
        self.bare = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None}))
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.table = chunks.Table(self._worked, weigh=len)

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        for lo in range(0, len(texts), 1024):
            for e in self.tk.encode_batch_fast(texts[lo : lo + 1024], add_special_tokens=False):
                yield np.array(e.ids, self.dtype).tobytes()

    def _worked(self, parts: list[str]) -> list[bytes]:
        """Ids of each word; those of a space and letters are many to a text, told apart by the tokens that hold the space."""
        out: list = [None] * len(parts)
        plain = [k for k, p in enumerate(parts) if p[0] == " " and p[1:].isalpha() and (p.isascii() or max(p) < "ɀ")]
        for lo in range(0, len(plain), JOIN * 64):
            some = plain[lo : lo + JOIN * 64]
            groups = [some[i : i + JOIN] for i in range(0, len(some), JOIN)]
            for g, e in zip(groups, self.bare.encode_batch_fast(["".join([parts[k] for k in g]) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                at = (np.flatnonzero(self.spaces[ids]) * self.dtype.itemsize).tolist()
                raw = ids.tobytes()
                for k, i, j in zip(g, at, [*at[1:], len(raw)]):
                    out[k] = raw[i:j]
        rest = [k for k, v in enumerate(out) if v is None]
        for k, v in zip(rest, self._ids([parts[k] for k in rest])):
            out[k] = v
        return out

    def encode(self, texts: pa.Array, end: int | None = None) -> Iterator[bytes]:
        """Ids of each text, null as empty, with an end id behind if one is given."""
        texts = texts.cast(pa.string()).fill_null("")
        stop = b"" if end is None else np.array([end], self.dtype).tobytes()
        size = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)) if len(texts) else np.zeros(0, np.int32)
        group = (np.cumsum(size, dtype=np.int64) - size) // SLICE
        at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() if len(texts) else []
        for lo, hi in zip(at, [*at[1:], len(texts)]):
            for ids in self._slice(texts.slice(lo, hi - lo)):
                yield ids + stop

    def _slice(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, _ODD) if self.cuts else pa.array(np.ones(len(texts), bool))
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd, empty = odd.to_numpy(zero_copy_only=False), pc.equal(texts, "").to_numpy(zero_copy_only=False)
        even, odd = np.flatnonzero(~odd & ~empty), np.flatnonzero(odd & ~empty)
        out = [b""] * len(texts)
        if len(even):
            for k, ids in zip(even.tolist(), self._even(texts if len(even) == len(texts) else texts.take(pa.array(even)))):
                out[k] = ids
        for k, ids in zip(odd.tolist(), self._ids(texts.take(pa.array(odd)).to_pylist())):
            out[k] = ids
        return out

    def _even(self, texts: pa.Array) -> Iterator[bytes]:
        """Texts that are not empty and not odd: cut, made distinct and joined back by position as whole arrays."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        data = np.frombuffer(texts.buffers()[2], np.uint8, int(offsets[-1]))[offsets[0] :]
        starts = offsets[:-1] - offsets[0]
        begin = np.flatnonzero(cuts(data, starts)).astype(np.int32)
        flat = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.r_[begin, np.int32(len(data))]), pa.py_buffer(data)).dictionary_encode()
        values = self.table.of(flat.dictionary.to_pylist())
        size = np.fromiter(map(len, values), np.int32, len(values)) // self.dtype.itemsize
        at = flat.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n, dtype=np.int64)
        ids = np.frombuffer(b"".join(values), self.dtype)
        where = np.repeat((np.cumsum(size) - size)[at] - (ends - n), n)
        where += np.arange(len(where))
        got = ids[where].tobytes()
        stops = (ends[np.r_[np.searchsorted(begin, starts[1:]), len(begin)] - 1] * self.dtype.itemsize).tolist()
        for i, j in zip([0, *stops], stops):
            yield got[i:j]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
    return Encoder(path)


def _check(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Turns documents into the rows of one file."""

    def __init__(self, number: int, dtype: np.dtype, row: int = ROW):
        self.number, self.dtype, self.most = number, dtype, row
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.row, self.rows = bytearray(), 0

    def _cut(self) -> bytes:
        out, self.row, self.rows = bytes(self.row), bytearray(), self.rows + 1
        self.entries.append((len(PAD), 0, _check(b"")))  # the separator that will follow
        return out

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[bytes]:
        frame = self.press.compress(ids)
        self.row += frame
        self.entries.append((len(frame), len(ids), _check(ids)))
        self.ids.append(doc_id)
        if len(self.row) >= self.most:
            yield self._cut()

    def finish(self) -> Iterator[bytes]:
        if self.row:
            yield self._cut()
        known = np.array([i is not None for i in self.ids], np.uint8)
        index = json.dumps({"file": self.number, "width": self.dtype.itemsize, "docs": len(self.ids)}).encode() + b"\n"
        index = self.press.compress(index + np.array([i or 0 for i in self.ids], "<i8").tobytes() + known.tobytes())
        table = np.array(self.entries, "<u4").tobytes()
        yield b"".join([
            struct.pack("<II", SKIPPABLE_INDEX, len(index)), index,
            struct.pack("<II", SKIPPABLE_TABLE, len(table) + 9), table, struct.pack("<IBI", len(self.entries), 0x80, TABLE_MAGIC),
        ])


class Reader:
    """Random access to one file's documents."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        end = len(content) - (len(PAD) if content[-len(PAD) :] == PAD else 0)
        n, flags, magic = struct.unpack("<IBI", self.content[end - 9 : end])
        if magic != TABLE_MAGIC or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        at = end - 9 - 12 * n
        table = np.frombuffer(self.content[at : end - 9], "<u4").reshape(n, 3).astype(np.int64)
        if struct.unpack("<II", self.content[at - 8 : at]) != (SKIPPABLE_TABLE, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        start = np.cumsum(table[:, 0]) - table[:, 0]
        first = int(table[:, 0].sum())
        magic, size = struct.unpack("<II", self.content[first : first + 8])
        if magic != SKIPPABLE_INDEX or first + 8 + size != at - 8:
            raise ValueError("the document index is damaged")
        self.open = zstandard.ZstdDecompressor()
        head, _, rest = self.open.decompress(self.content[first + 8 : first + 8 + size]).partition(b"\n")
        head = json.loads(head)
        self.number, self.width, docs = head["file"], head["width"], head["docs"]
        ids, known = np.frombuffer(rest[: 8 * docs], "<i8").tolist(), np.frombuffer(rest[8 * docs :], np.uint8)
        self.doc_ids = [i if k else None for i, k in zip(ids, known)]
        pads = [len(PAD), 0, _check(b"")]
        frames = ~(table == pads).all(axis=1)
        self.start, self.table = start[frames], table[frames]
        if len(self.table) != docs:
            raise ValueError("the document index does not fit the seek table")

    def n_tokens(self) -> np.ndarray:
        return self.table[:, 1] // self.width

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document: only its frame is decompressed, and checked."""
        size, plain, check = self.table[k].tolist()
        data = self.open.decompress(self.content[self.start[k] : self.start[k] + size], max_output_size=plain) if plain else b""
        if len(data) != plain or _check(data) != check:
            raise ValueError(f"frame {k} fails its checksum")
        return np.frombuffer(data, f"<u{self.width}")


def _files(path: str | None, end_id: int, n_rows: int, row: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda parts: ([pa.RecordBatch.from_arrays([pa.array([p], pa.binary())], names=["value"])] for p in parts)
        enc = _encoder(path or default_tokenizer())
        number, out = TaskContext.get().partitionId() << 32, None
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), enc.encode(b.column(1), end_id)):
                out = out or Writer(number, enc.dtype, row)
                for r in rows(out.add(i, data)):
                    yield from r
                if out.rows == n_rows - 1:  # with the tables it has n_rows, at which Spark's writer starts its next file
                    for r in rows(out.finish()):
                        yield from r
                    number, out = number + 1, None
        if out:
            for r in rows(out.finish()):
                yield from r

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, n_rows: int = ROWS, row: int = ROW) -> None:
    """Write the ids of every row of ``docs``, in ascending order of doc_id (null first), in files of about ``n_rows`` * ``row`` bytes at most.

    A task writes one range of doc_ids, file after file. Only a single document's frame can make a file longer.

    A null or empty text has the end id only. Rows that share a doc_id are spread over files by a hash of their text. An
    empty table writes no documents; other columns are ignored. ``path`` must not exist.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = narrow.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    rows = dealt.mapInArrow(_files(tokenizer, end_id, n_rows, row), "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", PAD.decode("latin-1")).option("maxRecordsPerFile", n_rows).text(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            r = Reader(content.as_py())
            n = r.n_tokens()
            start = np.cumsum(n) - n
            crc = [zlib.crc32(r.ids(k).astype("<u4")) for k in range(len(n))]
            yield pa.RecordBatch.from_arrays([pa.array([r.number] * len(n), pa.int64()), pa.array(r.doc_ids, pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())], names=["file", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files: start counts all ids before it, in file order."""
    rows = _read(spark, path).mapInArrow(_digests, "file long, doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = common.cut(rows, "digests")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # one row per file
    files = files.select(F.col("file").alias("f"), (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(files), F.col("file") == F.col("f")).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of all documents, or of those asked for: frames of others are not decompressed."""
    asked = None if doc_ids is None else frozenset(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                r = Reader(content.as_py())
                want = [k for k, i in enumerate(r.doc_ids) if asked is None or i in asked]
                for lo in range(0, len(want), 256):
                    some = want[lo : lo + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([r.doc_ids[k] for k in some], pa.int64()), pa.array([r.ids(k).astype(np.int32) for k in some], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _read(spark, path).mapInArrow(run, "doc_id long, ids array<int>")


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to files in the shared folder and return what `read_digests` reads back from them."""
    path = common.scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, id_col, text_col, tokenizer)
    return read_digests(docs.sparkSession, path)
