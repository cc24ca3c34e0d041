"""Near copies by SimHash candidates and an exact check of each.

Two documents are linked if their sets of five-word shingles have a Jaccard similarity of at least 0.8; groups are what links
connect. Candidates are pairs of fingerprints within RADIUS bits, of sets whose sizes allow the similarity. Fingerprints are of
three-word shingles, which move less with each changed word: at 0.8 they differ in 7 or 8 bits on average.

Fingerprints lie in tiles by size of the set and by population count. Tiles whose sizes cannot reach the similarity, or whose
counts differ beyond the radius, are skipped; within the others, numpy takes exclusive-or and counts bits. A first pass tells
which nodes have a candidate in which unit of work. A second brings their sets of shingles to these units, checks every
candidate pair there, and reports a spanning forest of the links. So no pair is ever written down, and none is left out; where
very many pairs meet, as in a large group of copies, sets are compared as rows of bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelog.llm import common, exact, simhash

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 12
#: Bits of the population count that share a tile; nodes of a block; nodes that are compared at a time.
STEP, BLOCK, LEFT, RIGHT = 4, 16384, 512, 4096
#: Links held before they shrink to a forest; candidates from which on sets are compared as bits; bits of such a table at most.
HELD, MANY, BITS = 1 << 20, 4096, 1 << 29


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the lower-cased (A-Z) words; fewer words are one shingle, none is none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64))


def _facts(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                fp, size, digest = [], [], []
                for t in part.column(1).cast(pa.binary()).to_pylist():
                    s = shingles(t or b"", shingle)
                    fp.append(simhash.fingerprint(t or b""))
                    size.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                prints = np.frombuffer(b"".join(fp), ">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints), pa.array(size, pa.int32()), pa.array(digest, pa.binary())], names=["rid", "fp", "size", "digest"])

    return run


class Side:
    """Nodes of one side of a comparison: fingerprints, numbers, sizes of their sets, and in the second pass the sets."""

    def __init__(self, fp: np.ndarray, node: np.ndarray, size: np.ndarray, sets: list[np.ndarray] | None):
        self.fp, self.node, self.size, self.sets = fp, node, size, sets

    def __len__(self) -> int:
        return len(self.fp)

    def part(self, lo: int, hi: int) -> Side:
        return Side(self.fp[lo:hi], self.node[lo:hi], self.size[lo:hi], self.sets and self.sets[lo:hi])

    @classmethod
    def joined(cls, sides: list[Side]) -> Side:
        cols = [np.concatenate([getattr(s, c) for s in sides]) for c in ("fp", "node", "size")]
        return cls(*cols, [x for s in sides for x in s.sets] if sides[0].sets is not None else None)


def _near(u: Side, v: Side, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the candidate pairs."""
    x, y = np.nonzero(np.bitwise_count(u.fp[:, None] ^ v.fp[None, :]) <= radius)
    a, b = u.size[x], v.size[y]
    ok = (u.node[x] != v.node[y]) & (np.minimum(a, b) >= similarity * np.maximum(a, b))
    return x[ok], y[ok]


def _shared(u: Side, v: Side, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many shingles the sets of each pair share."""
    if len(x) < MANY:
        return np.array([len(np.intersect1d(u.sets[i], v.sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist())], np.int64)
    rows, cols = np.unique(x), np.unique(y)
    left, right = [u.sets[i] for i in rows.tolist()], [v.sets[j] for j in cols.tolist()]
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    if not len(both):
        return np.zeros(len(x), np.int64)
    width = -(-len(both) // 64)
    if (len(rows) + len(cols)) * width * 64 > BITS:  # sets too large for one table: half of the pairs at a time
        half = len(x) // 2
        return np.concatenate([_shared(u, v, x[:half], y[:half]), _shared(u, v, x[half:], y[half:])])

    def table(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), width * 64), np.uint8)
        for k, one in enumerate(sets):
            at = np.searchsorted(both, one)
            at = at[(at < len(both)) & (both[np.minimum(at, len(both) - 1)] == one)]
            out[k, at] = 1
        return np.packbits(out, axis=1).view(np.uint64)

    p, q = table(left), table(right)
    i, j, out = np.searchsorted(rows, x), np.searchsorted(cols, y), np.empty(len(x), np.int64)
    step = max(1, (1 << 21) // width)
    for lo in range(0, len(x), step):
        out[lo : lo + step] = np.bitwise_count(p[i[lo : lo + step]] & q[j[lo : lo + step]]).sum(axis=1, dtype=np.int64)
    return out


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Side, Side]]:
    """(unit, its own block, some of what it meets) of rows that come sorted by (unit, side)."""
    unit, left, own = None, [], None
    for b in batches:
        units, sides = b.column(0).to_numpy(), b.column(1).to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in b.column(5).to_pylist()] if b.num_columns > 5 else None
        rows = Side(b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy(), b.column(4).to_numpy(), sets)
        cuts = np.flatnonzero((units[1:] != units[:-1]) | (sides[1:] != sides[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(units)]):
            if lo == hi:
                continue
            if units[lo] != unit:
                unit, left, own = units[lo], [], None
            if sides[lo] == 0:
                left.append(rows.part(lo, hi))
            elif left:
                own = own or Side.joined(left)
                yield unit, own, rows.part(lo, hi)


def _pairs(batches: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[tuple]:
    for unit, own, met in _sides(batches):
        for i in range(0, len(own), LEFT):
            u = own.part(i, i + LEFT)
            for j in range(0, len(met), RIGHT):
                v = met.part(j, j + RIGHT)
                x, y = _near(u, v, radius, similarity)
                if len(x):
                    yield unit, u, v, x, y


def _hits(radius: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []

        def done() -> pa.RecordBatch:
            nodes = np.unique(np.concatenate(found))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), now)), pa.array(nodes)], names=["unit", "node"])

        for unit, u, v, x, y in _pairs(batches, radius, similarity):
            if unit != now:
                if found:
                    yield done()
                now, found = unit, []
            found += [u.node[np.unique(x)], v.node[np.unique(y)]]
        if found:
            yield done()

    return run


def _links(radius: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, u, v, x, y in _pairs(batches, radius, similarity):
            both = _shared(u, v, x, y)
            ok = both >= similarity * (u.size[x] + v.size[y] - both)
            if ok.any():
                held.append((u.node[x[ok]], v.node[y[ok]]))
                n += int(ok.sum())
                if n > HELD:
                    held = [simhash.forest(*map(np.concatenate, zip(*held)))]
                    n = len(held[0][0])
        if n:
            a, b = simhash.forest(*map(np.concatenate, zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _units(nodes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(unit, side, fp, node, size): every node in its own unit, and in those whose block it is compared with."""
    reach, far = -(-radius // STEP), 64 // STEP + 1
    band = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / F.log(F.lit(1 / similarity))).cast("int")
    rows = nodes.select("node", "fp", F.col("size").cast("long").alias("size"), band.alias("band"), F.floor(F.bit_count("fp") / STEP).cast("int").alias("pc"))
    tile = lambda up, d: (F.col("band") - up) * far + F.col("pc") - d
    # Each unordered pair of tiles is met from one of them: the same band and a lower count, or the band below.
    steps = [(0, d) for d in range(reach + 1)] + [(1, d) for d in range(-reach, reach + 1)]
    sizes = rows.groupBy(tile(0, 0).alias("tile")).agg(F.count("*").alias("c")).select("tile", F.ceil(F.col("c") / F.lit(BLOCK)).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes)  # a few hundred tiles: logarithms of a text's length, times 17
    cols = ["fp", "node", "size"]
    own = rows.withColumn("tile", tile(0, 0)).join(sizes, "tile").select((F.col("tile").cast("long") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("unit"), F.lit(0).cast("byte").alias("side"), *cols)
    fits = [F.when((F.col("pc") - d).between(0, far - 1), tile(up, d)) for up, d in steps]
    met = rows.withColumn("tile", F.explode(F.filter(F.array(*fits), lambda t: t.isNotNull()))).join(sizes, "tile")
    met = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select((F.col("tile").cast("long") * (1 << 32) + F.col("block")).alias("unit"), F.lit(1).cast("byte").alias("side"), *cols)
    return own.union(met)


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = [shingles(t or b"", shingle).tobytes() for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


def links(nodes: DataFrame, texts: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Spanning forests (a, b) of all links between stored nodes (node, fp, size); ``texts`` (rid, text) has a row of each node."""
    units = _units(nodes, radius, similarity)
    sort = lambda df: df.repartition("unit").sortWithinPartitions("unit", "side")
    hits, path = common.table(sort(units).mapInArrow(_hits(radius, similarity), "unit long, node long"), "hits")
    wanted = hits.select("node").distinct().withColumnRenamed("node", "rid")
    sets, held = common.table(texts.join(wanted, "rid", "left_semi").select("rid", "text").mapInArrow(_sets(shingle), "node long, set binary"), "sets")
    rows = units.join(hits, ["unit", "node"], "left_semi").join(sets, "node").select("unit", "side", "fp", "node", "size", "set")
    out = common.cut(sort(rows).mapInArrow(_links(radius, similarity), "a long, b long"), "links")
    for p in (path, held):
        common.drop(nodes.sparkSession, p)
    return out


def classes(texts: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(rid, label) of rows (rid, text): equal labels for rows of one group, the least rid of its sets' first rows.

    Rows of the same set of shingles are one node; a null or wordless text has the empty set, which equals itself only.
    """
    facts = common.cut(texts.mapInArrow(_facts(shingle), "rid long, fp long, size int, digest binary"), "facts")
    keys = ["fp", "size", "digest"]
    nodes = common.cut(facts.groupBy(*keys).agg(F.min("rid").alias("node"), F.count("*").alias("c")), "nodes")
    roots = common.components(links(nodes, texts, radius, similarity, shingle))
    named = common.cut(nodes.join(roots, "node", "left").select(*keys, "c", F.coalesce("root", "node").alias("label")), "named")
    return exact._meet(facts, named, keys).select("rid", "label")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group, all columns kept: that of the smallest doc_id, null last; one of them if rows share it.

    A null or wordless text is near to such texts only. An empty table gives an empty result.
    """
    rows, rid = common.with_rids(docs)
    key = common.fresh(rows, "__kept")
    texts = rows.select(F.col(rid).alias("rid"), F.col(text_col).cast("string").alias("text"))
    ids = rows.select(F.col(rid).alias("rid"), F.col(id_col).cast("long").alias("doc_id"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")
    kept = ids.join(classes(texts, similarity=similarity), "rid").groupBy("label").agg(best).select(F.col("best.rid").alias(key))
    return rows.join(kept, F.col(rid) == F.col(key), "left_semi").drop(rid)
