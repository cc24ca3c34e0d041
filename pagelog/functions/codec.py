"""The binary log format: header, page frames, page index, trailer.

A file is a 100-byte header; page frames in ascending page order; a zero page header; the index as uvarint triples (page,
offset, size), a zero and its byte length; and a trailer of two checksums. All integers are big-endian. The file checksum
covers the logical stream: everything but itself, with page bytes as they are before compression.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
import xxhash

from pagelog.functions import checksums as C

#: Fixed values of the format.
MAGIC = b"LTX1"
HEADER = struct.Struct(">4sIIIQQqQqqIIQ20x")
PAGE_V3, PAGE_V2, SIZE, TRAILER = struct.Struct(">IH"), struct.Struct(">I"), struct.Struct(">I"), struct.Struct(">QQ")
SIZED = 1
NO_CHECKSUM = 2
LOCK_BYTE = 0x40000000
LZ4_MAGIC, LZ4_FLAGS, LZ4_BLOCKS = 0x184D2204, 0x64, 0x40
FLAG = C.FLAG
VERSIONS = ("v2", "v3")

_lz4 = pa.Codec("lz4_raw")


class FormatError(ValueError):
    """A file that breaks the format; the message is the error's name."""


@dataclass(frozen=True)
class Limits:
    """Bounds that a file must keep; none is implied by the format."""

    max_input_bytes: int = 1 << 31
    max_pages: int = (1 << 32) - 1
    max_page_size: int = 65536
    max_compressed_page_size: int = 1 << 20
    max_page_index_bytes: int = 1 << 30
    max_varint_bytes: int = 10
    max_transaction_span: int = 1 << 64
    max_page_index_entries: int = (1 << 32) - 1

    def __post_init__(self):
        if any(getattr(self, f.name) < 1 for f in fields(self)) or self.max_varint_bytes > 10:
            raise FormatError("InvalidLimits")


@dataclass(frozen=True)
class Header:
    flags: int = 0
    page_size: int = 4096
    commit: int = 0
    min_txid: int = 1
    max_txid: int = 1
    timestamp_ms: int = 0
    pre_apply_checksum: int = 0
    wal_offset: int = 0
    wal_size: int = 0
    wal_salt_1: int = 0
    wal_salt_2: int = 0
    node_id: int = 0

    @property
    def snapshot(self) -> bool:
        return self.min_txid == 1

    @property
    def unchecked(self) -> bool:
        return bool(self.flags & NO_CHECKSUM)

    @property
    def lock_page(self) -> int:
        return LOCK_BYTE // self.page_size + 1

    def pack(self) -> bytes:
        return HEADER.pack(MAGIC, *(getattr(self, f.name) for f in fields(self)))

    @classmethod
    def unpack(cls, data: bytes) -> Header:
        magic, *rest = HEADER.unpack(data)
        if magic != MAGIC:
            raise FormatError("InvalidMagic")
        return cls(*rest)

    def check(self, limits: Limits = Limits()) -> None:
        if self.flags & ~NO_CHECKSUM:
            raise FormatError("InvalidHeaderFlags")
        if not (512 <= self.page_size <= 65536 and self.page_size & (self.page_size - 1) == 0):
            raise FormatError("InvalidPageSize")
        if self.page_size > limits.max_page_size:
            raise FormatError("PageSizeLimitExceeded")
        if not 1 <= self.min_txid <= self.max_txid:
            raise FormatError("InvalidTXIDRange")
        if self.max_txid - self.min_txid + 1 > limits.max_transaction_span:
            raise FormatError("TransactionSpanLimitExceeded")
        if min(self.wal_offset, self.wal_size) < 0 or (not self.wal_offset and (self.wal_salt_1 or self.wal_salt_2 or self.wal_size)):
            raise FormatError("InvalidWALMetadata")
        if self.pre_apply_checksum if self.snapshot or self.unchecked else not self.pre_apply_checksum & FLAG:
            raise FormatError("InvalidPreApplyChecksum")
        if self.snapshot and self.snapshot_pages > limits.max_pages:
            raise FormatError("PageLimitExceeded")
        if self.snapshot and self.snapshot_pages > limits.max_page_index_entries:
            raise FormatError("PageIndexLimitExceeded")

    @property
    def snapshot_pages(self) -> int:
        return self.commit - (self.lock_page <= self.commit)

    def check_trailer(self, post: int, file: int) -> None:
        if self.unchecked:
            if post:
                raise FormatError("InvalidTrailer")
        elif not post & FLAG:
            raise FormatError("InvalidChecksumFormat")
        elif not self.commit and post != FLAG:
            raise FormatError("InvalidTrailer")
        if not file & FLAG:
            raise FormatError("InvalidChecksumFormat")

    def continues(self, txid: int, post: int) -> None:
        """Raise unless this file follows a position."""
        if txid != self.min_txid - 1:
            raise FormatError("NonContiguousTransition")
        if not self.unchecked and post != self.pre_apply_checksum:
            raise FormatError("DivergentHistory")


@dataclass
class LogFile:
    header: Header
    numbers: list[int] = field(default_factory=list)
    pages: list[bytes] = field(default_factory=list)
    index: list[tuple[int, int, int]] = field(default_factory=list)
    flags: list[int] = field(default_factory=list)
    post_apply_checksum: int = 0
    file_checksum: int = 0
    byte_count: int = 0
    sums: np.ndarray | None = None

    def page_sums(self) -> np.ndarray:
        """Remainders of the pages' bytes, worked out once."""
        if self.sums is None:
            self.sums = C.remainders(np.frombuffer(b"".join(self.pages), np.uint8).reshape(len(self.pages), self.header.page_size))
        return self.sums

    def page_checksums(self) -> np.ndarray:
        return C.numbered(np.array(self.numbers, np.int64), self.page_sums(), self.header.page_size)

    def logical_sum(self, start: bytes, heads: list[bytes], tail: bytes) -> int:
        """The file's checksum: of the header, each page's head and bytes, and the tail up to the checksum itself."""
        if len({*map(len, heads)}) > 1:  # older frames among others
            return C.crc64(b"".join([start, *[x for pair in zip(heads, self.pages) for x in pair], tail])) | FLAG
        state, n = C.after(C.ONES, C.remainders(np.frombuffer(start, np.uint8)[None, :]), len(start))[0], len(heads)
        if n:
            size = len(heads[0]) + self.header.page_size
            each = C.after(C.remainders(np.frombuffer(b"".join(heads), np.uint8).reshape(n, -1)), self.page_sums(), self.header.page_size)
            state = C.after(state, C.joined(each, size), n * size)[0]
        return int(C.after(state, C.remainders(np.frombuffer(tail, np.uint8)[None, :]), len(tail))[0]) ^ C.ONES | FLAG


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_uvarint(data: bytes, at: int, most: int = 10) -> tuple[int, int]:
    """(value, offset after it); longer forms than needed are errors."""
    value = 0
    for k in range(most):
        if at + k >= len(data):
            raise FormatError("TruncatedInput")
        b = data[at + k]
        if k == 9 and b > 1:
            raise FormatError("VarintOverflow")
        value |= (b & 0x7F) << 7 * k
        if not b & 0x80:
            if k and not b:
                raise FormatError("OverlongVarint")
            return value, at + k + 1
    raise FormatError("VarintOverflow" if most == 10 else "PageIndexLimitExceeded")


def lz4_block(data: bytes, size: int) -> bytes:
    """A raw LZ4 block that must decode to exactly ``size`` bytes."""
    try:
        out = _lz4.decompress(data, size, asbytes=True)
    except Exception:
        raise FormatError("InvalidLZ4Block") from None
    if len(out) != size:
        raise FormatError("DecompressedSizeMismatch")
    return out


def lz4_literals(data: bytes) -> bytes:
    """A raw LZ4 block of literals only: what any input can be written as."""
    n = len(data)
    if n < 15:
        return bytes([n << 4]) + data
    more, last = divmod(n - 15, 255)
    return b"\xf0" + b"\xff" * more + bytes([last]) + data


def lz4_compress(data: bytes) -> bytes:
    best = _lz4.compress(data, asbytes=True)
    return best if len(best) < len(data) + len(data) // 255 + 2 else lz4_literals(data)


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FormatError("TruncatedInput")
        self.at += n
        return self.data[self.at - n : self.at]


def lz4_frame(c: _Cursor, size: int, most: int) -> bytes:
    """One LZ4 frame of one block, stored or compressed, with its content checksum."""
    d = c.take(7)
    if d[:4] != struct.pack("<I", LZ4_MAGIC) or d[4] != LZ4_FLAGS or d[5] != LZ4_BLOCKS or d[6] != (xxhash.xxh32_intdigest(d[4:6]) >> 8) & 255:
        raise FormatError("InvalidLZ4Frame")
    (word,) = struct.unpack("<I", c.take(4))
    n, stored = word & 0x7FFFFFFF, bool(word >> 31)
    if not n:
        raise FormatError("InvalidCompressedSize")
    if n > most:
        raise FormatError("CompressedPageLimitExceeded")
    block = c.take(n)
    if stored and n != size:
        raise FormatError("DecompressedSizeMismatch")
    page = block if stored else lz4_block(block, size)
    if c.take(4) != bytes(4):
        raise FormatError("InvalidLZ4Frame")
    if struct.unpack("<I", c.take(4))[0] != xxhash.xxh32_intdigest(page):
        raise FormatError("LZ4ContentChecksumMismatch")
    return page


def decode(data: bytes, version: str = "v3", limits: Limits = Limits(), header_only: bool = False) -> LogFile:
    """A verified file; FormatError names the first thing wrong with it. ``header_only`` reads and checks just the header."""
    if version not in VERSIONS:
        raise FormatError("UnsupportedFormatVersion")
    if len(data) > limits.max_input_bytes:
        raise FormatError("InputLimitExceeded")
    c = _Cursor(data)
    h = Header.unpack(c.take(HEADER.size))
    h.check(limits)
    out = LogFile(h, byte_count=len(data))
    if header_only:
        return out
    heads, last = [], 0
    while True:
        begin = c.at
        head = c.take(PAGE_V3.size if version == "v3" else PAGE_V2.size)
        number, flags = PAGE_V3.unpack(head) if version == "v3" else (*PAGE_V2.unpack(head), 0)
        if not number and not flags:
            break
        _check_page(h, number, flags, last, len(out.numbers), limits)
        if flags & SIZED:
            size = c.take(SIZE.size)
            head += size
            (n,) = SIZE.unpack(size)
            if not n:
                raise FormatError("InvalidCompressedSize")
            if n > limits.max_compressed_page_size:
                raise FormatError("CompressedPageLimitExceeded")
            page = lz4_block(c.take(n), h.page_size)
        else:
            page = lz4_frame(c, h.page_size, limits.max_compressed_page_size)
        heads.append(head)
        out.numbers.append(number)
        out.flags.append(flags)
        out.pages.append(page)
        out.index.append((number, begin, c.at - begin))
        last = number
    if h.snapshot and (len(out.numbers) != h.snapshot_pages or (h.commit and last != h.commit - (h.commit == h.lock_page))):
        raise FormatError("SnapshotPageSequence")
    begin = c.at
    _read_index(c, out, limits)
    tail = head + data[begin : c.at]
    trailer = c.take(TRAILER.size)
    tail += trailer[:8]
    out.post_apply_checksum, out.file_checksum = TRAILER.unpack(trailer)
    h.check_trailer(out.post_apply_checksum, out.file_checksum)
    if out.logical_sum(data[: HEADER.size], heads, tail) != out.file_checksum:
        raise FormatError("ChecksumMismatch")
    if h.snapshot and not h.unchecked and database_checksum(out.page_checksums()) != out.post_apply_checksum:
        raise FormatError("SnapshotChecksumMismatch")
    if c.at != len(data):
        raise FormatError("TrailingBytes")
    return out


def _check_page(h: Header, number: int, flags: int, last: int, count: int, limits: Limits) -> None:
    if not number:
        raise FormatError("InvalidPageNumber")
    if flags & ~SIZED:
        raise FormatError("InvalidPageFlags")
    if count >= limits.max_pages:
        raise FormatError("PageLimitExceeded")
    if count >= limits.max_page_index_entries:
        raise FormatError("PageIndexLimitExceeded")
    if number > h.commit:
        raise FormatError("InvalidPageNumber")
    if number == h.lock_page:
        raise FormatError("LockPagePresent")
    if h.snapshot:
        if number != last + 1 + (last > 0 and last == h.lock_page - 1):
            raise FormatError("SnapshotPageSequence")
    elif number <= last:
        raise FormatError("PageOutOfOrder")


def _read_index(c: _Cursor, out: LogFile, limits: Limits) -> None:
    begin = c.at

    def number() -> int:
        value, c.at = read_uvarint(c.data, c.at, limits.max_varint_bytes)
        if c.at - begin > limits.max_page_index_bytes:
            raise FormatError("PageIndexLimitExceeded")
        return value

    for want in out.index:
        page = number()
        if not 0 < page < 1 << 32:
            raise FormatError("InvalidPageIndex")
        if (page, number(), number()) != want:
            raise FormatError("PageIndexMismatch")
    if number():
        raise FormatError("InvalidPageIndex")
    size = c.at - begin
    if size + 8 > limits.max_page_index_bytes:
        raise FormatError("PageIndexLimitExceeded")
    if struct.unpack(">Q", c.take(8))[0] != size:
        raise FormatError("InvalidPageIndexSize")


def database_checksum(page_checksums: np.ndarray) -> int:
    """The flagged xor of page checksums; the lock page must not be among them."""
    return int(np.bitwise_xor.reduce(page_checksums, initial=np.uint64(0))) | FLAG


#: A file is one binary value of an Arrow batch, whose offsets are 32-bit numbers.
MAX_FILE_BYTES = (1 << 31) - 1


def uvarints(values: np.ndarray) -> bytes:
    """`uvarint` of each number, one after the other."""
    values = np.asarray(values, np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        on = size > k
        more = (size[on] > k + 1).astype(np.uint8) << 7
        out[at[on] + k] = ((values[on] >> np.uint64(7 * k)) & np.uint64(0x7F)).astype(np.uint8) | more
    return out.tobytes()


@dataclass
class Pressed:
    """Pages of one size, ready for a file: compressed blocks, the remainders of their bytes, and their checksums."""

    blocks: list[bytes]
    sums: np.ndarray
    checksums: np.ndarray


def press(numbers: np.ndarray, pages: np.ndarray, compress: bool = True) -> Pressed:
    """What `assemble` needs of pages (n, page_size); pages of one file may be pressed apart, in any order."""
    sums = C.remainders(pages)
    work = lz4_compress if compress else lz4_literals
    return Pressed([work(row.tobytes()) for row in pages], sums, C.numbered(numbers, sums, pages.shape[1]))


def assemble(header: Header, numbers: np.ndarray, pressed: Pressed, post_apply_checksum: int | None = None) -> bytes:
    """A v3 file of pressed pages in ascending order. A checked snapshot's post checksum is worked out, and must match if given.

    The file's checksum is joined from the pages' remainders; no page is read again.
    """
    header.check()
    numbers, n = np.asarray(numbers, np.int64), len(numbers)
    ok = not n or (numbers[0] > 0 and numbers[-1] <= header.commit and (np.diff(numbers) > 0).all() and header.lock_page not in numbers)
    if not ok or header.snapshot:
        last, want = 0, range(1, header.commit + 1)
        if not ok or numbers.tolist() != [k for k in want if k != header.lock_page]:
            for k, number in enumerate(numbers.tolist()):  # name the first fault
                _check_page(header, number, SIZED, last, k, Limits())
                last = number
            if header.snapshot:
                raise FormatError("SnapshotPageSequence")
    sizes = np.array([len(b) for b in pressed.blocks], np.int64)
    heads = np.zeros(n, np.dtype([("page", ">u4"), ("flags", ">u2"), ("size", ">u4")]))
    heads["page"], heads["flags"], heads["size"] = numbers, SIZED, sizes
    head, raw = header.pack(), heads.tobytes()
    step = heads.itemsize
    state = C.after(C.ONES, C.remainders(np.frombuffer(head, np.uint8)[None, :]), HEADER.size)[0]
    if n:
        each = C.after(C.remainders(np.frombuffer(raw, np.uint8).reshape(n, step)), pressed.sums, header.page_size)
        state = C.after(state, C.joined(each, step + header.page_size), n * (step + header.page_size))[0]
    post = 0
    if header.unchecked:
        if post_apply_checksum:
            raise FormatError("InvalidTrailer")
    elif header.snapshot:
        post = database_checksum(np.asarray(pressed.checksums, np.uint64))
        if post_apply_checksum is not None and post_apply_checksum != post:
            raise FormatError("SnapshotChecksumMismatch")
    else:
        post = post_apply_checksum or 0
    frame = sizes + step
    at = HEADER.size + np.cumsum(frame) - frame
    entries = uvarints(np.stack([numbers, at, frame], axis=1).ravel()) + b"\0"
    tail = PAGE_V3.pack(0, 0) + entries + struct.pack(">Q", len(entries)) + struct.pack(">Q", post)
    if HEADER.size + int(frame.sum()) + len(tail) + 8 > MAX_FILE_BYTES:
        raise FormatError("OutputLimitExceeded")
    file = int(C.after(state, C.remainders(np.frombuffer(tail, np.uint8)[None, :]), len(tail))[0]) ^ C.ONES | FLAG
    header.check_trailer(post, file)
    parts = [head]
    for k, block in enumerate(pressed.blocks):
        parts += (raw[k * step : (k + 1) * step], block)
    return b"".join([*parts, tail, struct.pack(">Q", file)])


def encode(header: Header, pages: Iterator[tuple[int, bytes]] | list[tuple[int, bytes]], post_apply_checksum: int | None = None, compress: bool = True) -> bytes:
    """A v3 file of pages (number, bytes). A checked snapshot's post checksum is worked out; others must give theirs."""
    header.check()
    pages, last = list(pages), 0
    for k, (number, page) in enumerate(pages):
        if number < 1:
            _check_page(header, number, SIZED, last, k, Limits())
        if len(page) != header.page_size:
            raise FormatError("InvalidPageDataSize")
        last = number
    numbers = np.array([n for n, _ in pages], np.int64)
    rows = np.frombuffer(b"".join([p for _, p in pages]), np.uint8).reshape(len(pages), header.page_size)
    return assemble(header, numbers, press(numbers, rows, compress), post_apply_checksum)


def read_index(data: bytes, version: str = "v3", limits: Limits = Limits()) -> tuple[Header, list[tuple[int, int, int]]]:
    """(header, index) of a file, found from its end: no page is looked at. The index is checked against the file's size only."""
    if version not in VERSIONS:
        raise FormatError("UnsupportedFormatVersion")
    if len(data) > limits.max_input_bytes:
        raise FormatError("InputLimitExceeded")
    h = Header.unpack(_Cursor(data).take(HEADER.size))
    h.check(limits)
    end = len(data) - TRAILER.size - 8
    if end < HEADER.size:
        raise FormatError("TruncatedInput")
    (size,) = struct.unpack_from(">Q", data, end)
    if not 0 < size <= end - HEADER.size:
        raise FormatError("InvalidPageIndexSize")
    out, at, before = [], end - size, HEADER.size
    while True:
        page, at = read_uvarint(data, at, limits.max_varint_bytes)
        if not page:
            break
        offset, at = read_uvarint(data, at, limits.max_varint_bytes)
        length, at = read_uvarint(data, at, limits.max_varint_bytes)
        if offset != before or offset + length > end - size:
            raise FormatError("InvalidPageIndex")
        if len(out) >= min(limits.max_pages, limits.max_page_index_entries):
            raise FormatError("PageLimitExceeded")
        out.append((page, offset, length))
        before = offset + length
    if at != end:
        raise FormatError("InvalidPageIndexSize")
    return h, out


def compact(files: list[LogFile]) -> bytes:
    """One file from a chain: newest page wins, cut at the last commit. The small-chain twin of `operators.merge.compact`."""
    if not files:
        raise FormatError("CompactionInputRequired")
    first, last = files[0].header, files[-1].header
    for a, b in zip(files, files[1:]):
        if a.header.page_size != b.header.page_size:
            raise FormatError("CompactionPageSizeMismatch")
        if a.header.unchecked != b.header.unchecked:
            raise FormatError("CompactionChecksumModeMismatch")
        b.header.continues(a.header.max_txid, a.post_apply_checksum)
    newest = {n: p for f in files for n, p in zip(f.numbers, f.pages)}
    header = replace(first, flags=first.flags & NO_CHECKSUM, commit=last.commit, max_txid=last.max_txid, timestamp_ms=last.timestamp_ms, wal_offset=0, wal_size=0, wal_salt_1=0, wal_salt_2=0, node_id=0)
    return encode(header, sorted((n, p) for n, p in newest.items() if n <= last.commit), files[-1].post_apply_checksum)
