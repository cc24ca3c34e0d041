import random
import struct

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelog.functions import checksums as C
from pagelog.functions import codec as K


def naive_crc(data: bytes) -> int:
    state = C.ONES
    for b in data:
        state ^= b
        for _ in range(8):
            state = state >> 1 ^ (C.POLYNOMIAL if state & 1 else 0)
    return state ^ C.ONES


def test_known_checksums():
    assert C.crc64(b"123456789") == 0xB90956C775A41001
    assert C.page_checksum(1, bytes(i % 256 for i in range(512))) == 0xC6F13286CB62CC9F
    acc = C.FLAG
    for n in (1, 2, 3):
        acc = C.rolling_add(acc, C.page_checksum(n, bytes([n]) * 512))
    assert acc == 0xEFFFFFFFECD99000
    with pytest.raises(ValueError):
        C.rolling_add(1, C.FLAG)
    with pytest.raises(ValueError):
        C.page_checksum(0, bytes(512))


@given(st.binary(max_size=700))
@settings(max_examples=60, deadline=None)
def test_crc_of_any_length(data):
    assert C.crc64(data) == naive_crc(data)


def test_crc_over_blocks(monkeypatch):
    data = random.Random(1).randbytes(5000)
    want = C.crc64(data)
    monkeypatch.setattr(C, "BLOCK", 333)
    assert C.crc64(data) == want == naive_crc(data)


def test_database_checksum_has_no_order():
    pages = [random.Random(k).randbytes(512) for k in range(5)]
    sums = np.array([C.page_checksum(k + 1, p) for k, p in enumerate(pages)], np.uint64)
    assert K.database_checksum(sums) == K.database_checksum(sums[::-1])
    assert K.database_checksum(np.zeros(0, np.uint64)) == C.FLAG


@given(st.binary(max_size=2000).filter(lambda b: True))
@settings(max_examples=40, deadline=None)
def test_lz4_round_trip(data):
    assert K.lz4_block(K.lz4_literals(data), len(data)) == data
    if data:
        assert K.lz4_block(K.lz4_compress(data), len(data)) == data


@pytest.mark.parametrize("n", [0, 1, 14, 15, 16, 269, 270, 271, 524, 525])
def test_literal_lengths(n):
    assert K.lz4_block(K.lz4_literals(bytes(range(256)) * 3)[:0] + K.lz4_literals(bytes(n)), n) == bytes(n)


@pytest.mark.parametrize(("n", "raw"), [(0, "00"), (300, "ac02"), (2**64 - 1, "ff" * 9 + "01")])
def test_uvarint(n, raw):
    assert K.uvarint(n).hex() == raw
    assert K.read_uvarint(bytes.fromhex(raw), 0) == (n, len(raw) // 2)


@pytest.mark.parametrize(("raw", "error"), [("8000", "OverlongVarint"), ("ff" * 9 + "02", "VarintOverflow"), ("80", "TruncatedInput")])
def test_bad_uvarint(raw, error):
    with pytest.raises(K.FormatError, match=error):
        K.read_uvarint(bytes.fromhex(raw), 0)


def snapshot(pages, page_size=512, **kw):
    return K.encode(K.Header(page_size=page_size, commit=len(pages), **kw), list(enumerate(pages, 1)))


def test_zero_page_snapshot():
    f = K.decode(snapshot([bytes(512)]))
    assert f.post_apply_checksum == 0xEFB1F44FECD99000
    assert (f.numbers, f.pages, f.header.snapshot) == ([1], [bytes(512)], True)


def test_empty_snapshot():
    f = K.decode(snapshot([]))
    assert (f.post_apply_checksum, f.file_checksum, f.byte_count) == (0x8000000000000000, 0xEF752D544AC8C48F, 131)


@pytest.mark.parametrize("page_size", [512, 4096, 65536])
def test_round_trip(page_size):
    r = random.Random(page_size)
    pages = [r.randbytes(page_size), bytes(page_size), (b"ab" * page_size)[:page_size]]
    for compress in (True, False):
        data = K.encode(K.Header(page_size=page_size, commit=3), list(enumerate(pages, 1)), compress=compress)
        assert K.decode(data).pages == pages


def legacy(version: str, stored: bool) -> bytes:
    """A snapshot of one page in an LZ4 frame."""
    page, head = b"\xa5" * 512, K.Header(page_size=512, commit=1)
    block = page if stored else K.lz4_compress(page)
    lead = struct.pack(">IH", 1, 0) if version == "v3" else struct.pack(">I", 1)
    descriptor = bytes([K.LZ4_FLAGS, K.LZ4_BLOCKS])
    frame = struct.pack("<I", K.LZ4_MAGIC) + descriptor + bytes([xxhash.xxh32_intdigest(descriptor) >> 8 & 255])
    frame += struct.pack("<I", len(block) | stored << 31) + block + bytes(4) + struct.pack("<I", xxhash.xxh32_intdigest(page))
    index = K.uvarint(1) + K.uvarint(100) + K.uvarint(len(lead) + len(frame)) + b"\0"
    tail = bytes(len(lead)) + index + struct.pack(">Q", len(index)) + struct.pack(">Q", K.database_checksum(np.array([C.page_checksum(1, page)], np.uint64)))
    file = C.crc64(head.pack() + lead + page + tail) | C.FLAG
    return head.pack() + lead + frame + tail + struct.pack(">Q", file)


@pytest.mark.parametrize("version", ["v2", "v3"])
@pytest.mark.parametrize("stored", [False, True])
def test_frames_of_older_files(version, stored):
    assert K.decode(legacy(version, stored), version).pages == [b"\xa5" * 512]
    with pytest.raises(K.FormatError):
        K.decode(legacy(version, stored), "v3" if version == "v2" else "v2")


def test_every_truncation_and_flip_fails():
    # random pages: in a page of one byte, other matches could give the same page, which no checksum can tell
    data = snapshot([random.Random(k).randbytes(512) for k in (1, 2)])
    for n in range(len(data)):
        with pytest.raises(K.FormatError):
            K.decode(data[:n])
    with pytest.raises(K.FormatError, match="TrailingBytes"):
        K.decode(data + b"\0")
    for k in range(len(data)):
        if 80 <= k < 100:
            continue  # reserved bytes are ignored by readers, but the file checksum covers them
        bad = bytearray(data)
        bad[k] ^= 1
        try:
            # a block's last token has bits without a meaning, and no checksum covers the block as it is written
            assert K.decode(bytes(bad)).pages == K.decode(data).pages and k in (110, 635)
        except K.FormatError:
            pass


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"flags": 1}, "InvalidHeaderFlags"), ({"page_size": 1000}, "InvalidPageSize"), ({"min_txid": 0}, "InvalidTXIDRange"), ({"min_txid": 3, "max_txid": 2}, "InvalidTXIDRange"),
        ({"wal_offset": -1}, "InvalidWALMetadata"), ({"wal_salt_1": 1}, "InvalidWALMetadata"), ({"pre_apply_checksum": 1 << 63}, "InvalidPreApplyChecksum"),
        ({"min_txid": 2, "max_txid": 2}, "InvalidPreApplyChecksum"), ({"min_txid": 2, "max_txid": 2, "flags": 2, "pre_apply_checksum": 1}, "InvalidPreApplyChecksum"),
    ],
)
def test_header_rules(change, error):
    with pytest.raises(K.FormatError, match=error):
        K.Header(**{"page_size": 512, **change}).check()


def test_page_rules():
    head = K.Header(page_size=65536, commit=16386, min_txid=7, max_txid=8, pre_apply_checksum=1 << 63)
    page = bytes(65536)
    assert K.decode(K.encode(head, [(16384, page), (16386, page)], 1 << 63)).numbers == [16384, 16386]
    for numbers, error in (([16385], "LockPagePresent"), ([2, 2], "PageOutOfOrder"), ([16387], "InvalidPageNumber"), ([0], "InvalidPageNumber")):
        with pytest.raises(K.FormatError, match=error):
            K.encode(head, [(n, page) for n in numbers], 1 << 63)
    with pytest.raises(K.FormatError, match="SnapshotPageSequence"):
        K.encode(K.Header(page_size=512, commit=2), [(2, bytes(512))])
    with pytest.raises(K.FormatError, match="InvalidPageDataSize"):
        K.encode(K.Header(page_size=512, commit=1), [(1, bytes(511))])


def test_limits():
    data = snapshot([bytes(512)] * 3)
    for limit, error in (({"max_pages": 2}, "PageLimitExceeded"), ({"max_input_bytes": 10}, "InputLimitExceeded"), ({"max_compressed_page_size": 1}, "CompressedPageLimitExceeded"), ({"max_page_index_bytes": 3}, "PageIndexLimitExceeded")):
        with pytest.raises(K.FormatError, match=error):
            K.decode(data, limits=K.Limits(**limit))
    with pytest.raises(K.FormatError, match="InvalidLimits"):
        K.Limits(max_pages=0)


def test_compaction_of_a_checked_chain():
    first = K.decode(snapshot([bytes([k]) * 512 for k in (1, 2, 3)]))
    image = [bytes([9]) * 512, bytes([2]) * 512]
    post = K.database_checksum(np.array([C.page_checksum(k + 1, p) for k, p in enumerate(image)], np.uint64))
    second = K.decode(K.encode(K.Header(page_size=512, commit=2, min_txid=2, max_txid=2, pre_apply_checksum=first.post_apply_checksum), [(1, image[0])], post))
    out = K.decode(K.compact([first, second]))
    assert (out.pages, out.header.max_txid, out.post_apply_checksum) == (image, 2, post)
    with pytest.raises(K.FormatError, match="NonContiguousTransition"):
        K.compact([second, first])
