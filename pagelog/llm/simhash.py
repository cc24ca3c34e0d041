"""SimHash near-duplicate groups by tiled exact comparison.

Every fingerprint is compared, exactly, with every other one that could lie within the radius. Distinct fingerprints are
laid out in tiles by the population counts of their four 16-bit words (or eight bytes, where they are very many). Two
fingerprints whose counts differ by more than the radius in sum cannot link, so such tile pairs are skipped; within the others,
numpy takes exclusive-or and counts bits.
A tile is compared in blocks of bounded size, so no task holds more than one block on the left and one batch on the right.
Each block reports a spanning forest of its links, not the links, and the forests meet in `common.components`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelog.llm import common

SEED = 42
RADIUS = 2
SHINGLE = 3
#: Fingerprints of one tile that form a block; larger tiles are cut into blocks that all meet each other.
BLOCK = 4096
#: Shingles hashed at a time within one document, and links held before they shrink to a forest.
STEP, LINKS = 1 << 16, 1 << 20
#: Parts of a fingerprint whose population counts make its tile; beyond MANY distinct fingerprints, FINE parts, as tiles of the
#: others would be cut into many blocks. Both find the same links.
SEGMENTS, FINE, MANY = 4, 8, 1 << 26


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The 8 bytes, most significant first, of the SimHash of the lower-cased (A-Z) words of ``text``."""
    words = text.lower().split()  # on bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return bytes(8)
    if len(words) <= shingle:
        parts: Iterator[bytes] = iter([b" ".join(words)])
    else:
        parts = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle))))
    n, ones = 0, np.zeros(64, np.int64)
    while hashed := list(map(xxhash.xxh64_digest, islice(parts, STEP), repeat(SEED))):
        bits = np.unpackbits(np.frombuffer(b"".join(hashed), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashed)
    return np.packbits(2 * ones > n).tobytes()


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fp = np.frombuffer(b"".join(fingerprint(t or b"", shingle) for t in texts), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], names=["doc_id", "fp", "rid"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, rid: Column | None = None) -> DataFrame:
    """(doc_id, fp long, rid long) of every row; a null or wordless text has fingerprint zero.

    rid is monotonically_increasing_id() over ``docs`` if not given.
    """
    rid = F.monotonically_increasing_id() if rid is None else rid
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), rid.alias("rid"))
    return narrow.mapInArrow(_fingerprints(shingle), "doc_id long, fp long, rid long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each connected component of the links (a, b): (node, smallest node) for all others."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        if np.array_equal(new, label):
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _links(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(left), 512):
        for j in range(0, len(right), BLOCK):
            u, v = left[i : i + 512], right[j : j + BLOCK]
            near = np.bitwise_count(u[:, None] ^ v[None, :]) <= radius
            x, y = np.nonzero(near)
            if len(x):
                p, q = u[x], v[y]
                other = p != q
                yield p[other], q[other]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (unit, side): the unit's own block first, then what it meets, in batches."""
        unit, left, held, links, n = None, [], None, [], 0

        def flush() -> list[pa.RecordBatch]:
            nonlocal links, n
            if not n:
                return []
            a, b = forest(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
            links, n = [], 0
            return [pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])]

        for b in batches:
            units, sides = b.column(0).to_numpy(), b.column(1).to_numpy()
            fps = b.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((units[1:] != units[:-1]) | (sides[1:] != sides[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(units)]):
                if lo == hi:
                    continue
                if units[lo] != unit:
                    unit, left, held = units[lo], [], None
                if sides[lo] == 0:
                    left.append(fps[lo:hi])
                    continue
                if held is None:
                    held = np.concatenate(left) if left else np.zeros(0, np.uint64)
                for x, y in _links(held, fps[lo:hi], radius):
                    links.append((x, y))
                    n += len(x)
                    if n > LINKS:
                        a, c = forest(np.concatenate([p for p, _ in links]), np.concatenate([q for _, q in links]))
                        links, n = [(a, c)], len(a)
                        if n > LINKS // 2:
                            yield from flush()
        yield from flush()

    return run


def offsets(segments: int, radius: int) -> list[tuple[int, ...]]:
    """Steps from a tile to those that it meets: at most ``radius`` in sum, each unordered pair of tiles from the tile below."""
    out = [()]
    for _ in range(segments):
        out = [(*o, d) for o in out for d in range(-radius, radius + 1) if sum(map(abs, o)) + abs(d) <= radius]
    return [o for o in out if o >= (0,) * segments]  # zero, or led by a positive step


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """A spanning forest (a, b) of all links of at most ``radius`` bits between distinct fingerprints (fp long).

    Tiles are the population counts of ``segments`` equal parts of a fingerprint: more parts make smaller tiles, of which each
    fingerprint meets more. Any number gives the same links.
    """
    width = 64 // segments
    levels, mask = width + 1, (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit(mask))) for k in range(segments)]
    tiled = distinct.select("fp", F.array(*counts).alias("pc"))

    def at(o: tuple[int, ...]) -> Column:
        out = F.lit(0)
        for k in range(segments):
            out = out * F.lit(levels) + (F.col("pc")[k] - F.lit(o[k]))
        return out

    inside = lambda o: F.expr(" and ".join(f"pc[{k}] - {o[k]} between 0 and {levels - 1}" for k in range(segments) if o[k]) or "true")
    own_tile = at((0,) * segments)
    # Tiles that are cut into blocks: with four segments there are at most 17^4 = 83,521, safe to broadcast; else one in BLOCK rows.
    sizes = tiled.groupBy(own_tile.alias("tile")).agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("tile", F.ceil(F.col("c") / F.lit(BLOCK)).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes) if levels**segments <= 100_000 else sizes
    blocks = F.coalesce("blocks", F.lit(1))
    own = tiled.select("fp", own_tile.alias("tile")).join(sizes, "tile", "left")
    own = own.select((F.col("tile").cast("long") * (1 << 32) + F.pmod(F.xxhash64("fp"), blocks)).alias("unit"), F.lit(0).cast("byte").alias("side"), "fp")
    met = tiled.select("fp", F.explode(F.filter(F.array(*[F.when(inside(o), at(o)) for o in offsets(segments, radius)]), lambda t: t.isNotNull())).alias("tile")).join(sizes, "tile", "left")
    met = met.select((F.col("tile").cast("long") * (1 << 32)).alias("base"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "fp")
    met = met.select((F.col("base") + F.col("block")).alias("unit"), F.lit(1).cast("byte").alias("side"), "fp")
    dealt = own.union(met).repartition("unit").sortWithinPartitions("unit", "side")
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int, shingle: int, rid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, fp, rid) of every row, (fp, root, first_id) of every distinct fingerprint)"""
    fps = common.cut(fingerprints(docs, id_col, text_col, shingle, rid), "fp")
    distinct = common.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = common.components(links(distinct, radius, SEGMENTS if distinct.count() <= MANY else FINE))
    return fps, distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) for every row of ``docs``; other columns are ignored.

    Repeated rows and rows that share a doc_id each get their row. A null or wordless text has fingerprint zero, which links
    like any other. A null doc_id is no candidate for component_id; a group of such rows only has a null component_id.
    An empty table gives an empty result.
    """
    fps, named = _grouped(docs, id_col, text_col, radius, shingle)
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = named.join(lowest, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group, all columns kept: that of the smallest doc_id, null last; one of them if rows share it."""
    docs, rid = common.with_rids(docs)
    key = common.fresh(docs, "__kept")
    fps, named = _grouped(docs, id_col, text_col, radius, SHINGLE, F.col(rid))
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best"))
    kept = first.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.rid").alias(key))
    return docs.join(kept, F.col(rid) == F.col(key), "left_semi").drop(rid)
