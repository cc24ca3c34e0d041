"""Masked pseudo-likelihood scores from a bidirectional window network.

Words are counted over the whole corpus; the most frequent have classes of their own, all others share hashed classes. For
each position a network sees the words to the left and right within a window, not the word itself, and predicts it:
position-wise scaled embeddings are summed and squashed, and a two-level softmax (group, then member) gives the probability.
A word without a class of its own has its hashed class's probability times its part of that class's count, so all words of the
corpus have probabilities that sum to one. The counts of these words stay a distributed table, which scoring joins by word.
A document's score is the sum of the log probabilities of all its words.

Training covers the whole corpus: every position of every document is a target in exactly one round. In each round every task
runs Adagrad over its own rows from the shared parameters, and the tasks' parameters are averaged, weighted by positions. All
positions of all documents are scored. Texts are split into words once; the words' classes are kept in a stored table, which
all rounds and the scoring read. The parameters depend on the order of rows and on how they are dealt to tasks; scores of two
runs on the same files with the same settings agree but for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelog.llm import common

#: Classes: GROUPS * GROUPS in all, HASHED of them for words that are not among the most frequent.
GROUPS, HASHED = 48, 256
CLASSES = GROUPS * GROUPS
DIM, WINDOW = 16, 2
ROUNDS, BATCH, RATE = 2, 4096, 0.2
PAD = CLASSES
#: Bytes of text whose words are counted, and given classes, together.
COUNTED, CODED = 1 << 24, 1 << 22
_STEP = 1 << 12
_SHAPES = {"e": (CLASSES + 1, DIM), "a": (2 * WINDOW, DIM), "b": (DIM,), "wg": (DIM, GROUPS), "bg": (GROUPS,), "wm": (GROUPS, DIM, GROUPS), "bm": (GROUPS, GROUPS)}
_OFFSETS = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
#: Logits below this need no shift before exp.
_SAFE = 60.0


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


@dataclass
class Net:
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 7) -> Net:
        r = np.random.default_rng(seed)
        p = {k: (r.normal(0, 0.1, s)).astype(np.float32) for k, s in _SHAPES.items()}
        p["a"][:] = 1.0
        return cls(p)

    @classmethod
    def unpack(cls, flat: np.ndarray) -> Net:
        p, at = {}, 0
        for k, s in _SHAPES.items():
            n = int(np.prod(s))
            p[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return cls(p)

    def pack(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in _SHAPES]).astype(np.float64)

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        """(n, DIM + 1): the squashed sum of the scaled embeddings, and a one for the biases."""
        p = self.p
        z = np.empty((len(context), DIM + 1), p["e"].dtype)
        z[:, :DIM] = p["b"]
        for k in range(2 * WINDOW):
            z[:, :DIM] += np.take(p["e"] * p["a"][k], context[:, k], axis=0)
        np.tanh(z, out=z)
        z[:, DIM] = 1
        return z

    def _layers(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights with their biases as a last row: (DIM + 1, GROUPS) of groups, (GROUPS, DIM + 1, GROUPS) of members."""
        p = self.p
        return np.concatenate([p["wg"], p["bg"][None]]), np.concatenate([p["wm"], p["bm"][:, None]], axis=1)

    @staticmethod
    def _exp(z: np.ndarray, w: np.ndarray) -> np.ndarray:
        """exp of logits, in place, up to a factor per row; ``w`` made them from numbers between -1 and 1."""
        if np.abs(w).sum(axis=-2).max() >= _SAFE:
            z -= z.max(axis=1, keepdims=True)
        return np.exp(z, out=z)

    @staticmethod
    def _cuts(group: np.ndarray) -> list[tuple[int, int, int]]:
        """(group, from, to) of targets that are sorted by group."""
        at = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        return [(g, at[g], at[g + 1]) for g in range(GROUPS) if at[g] < at[g + 1]]

    def _members(self, h: np.ndarray, wm: np.ndarray, cuts: list[tuple[int, int, int]]) -> np.ndarray:
        z = np.empty((len(h), GROUPS), h.dtype)
        for g, lo, hi in cuts:
            np.matmul(h[lo:hi], wm[g], out=z[lo:hi])
        return self._exp(z, wm)

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of each target given its context (n, 2 * WINDOW)."""
        order = np.argsort(target, kind="stable")
        h, target, (wg, wm), n = self._hidden(context[order]), target[order], self._layers(), np.arange(len(target))
        group, member = target // GROUPS, target % GROUPS
        out, tiny = np.empty(len(target)), np.finfo(h.dtype).tiny
        zg = self._exp(h @ wg, wg)
        zm = self._members(h, wm, self._cuts(group))
        out[order] = np.log(np.maximum(zg[n, group], tiny)) - np.log(zg.sum(axis=1)) + np.log(np.maximum(zm[n, member], tiny)) - np.log(zm.sum(axis=1))
        return out

    def step(self, context: np.ndarray, target: np.ndarray, seen: dict[str, np.ndarray], rate: float) -> None:
        """One Adagrad step on the mean negative log probability."""
        order = np.argsort(target, kind="stable")
        context, target, n = context[order], target[order], len(target)
        p, h, (wg, wm), rows = self.p, self._hidden(context), self._layers(), np.arange(n)
        group, member = target // GROUPS, target % GROUPS
        cuts, grad = self._cuts(group), {}
        d = self._exp(h @ wg, wg)
        d /= d.sum(axis=1, keepdims=True)
        d[rows, group] -= 1
        got = h.T @ d
        grad["wg"], grad["bg"] = got[:DIM], got[DIM]
        dh = d @ p["wg"].T
        d = self._members(h, wm, cuts)
        d /= d.sum(axis=1, keepdims=True)
        d[rows, member] -= 1
        got = np.zeros_like(wm)
        back = np.empty_like(dh)
        for g, lo, hi in cuts:
            np.matmul(h[lo:hi].T, d[lo:hi], out=got[g])
            np.matmul(d[lo:hi], p["wm"][g].T, out=back[lo:hi])
        grad["wm"], grad["bm"] = got[:, :DIM], got[:, DIM]
        dh += back
        dz = dh * (1 - h[:, :DIM] ** 2)
        grad["b"] = dz.sum(axis=0)
        grad["a"] = np.stack([np.einsum("nd,nd->d", np.take(p["e"], context[:, k], axis=0), dz) for k in range(2 * WINDOW)])
        flat = context.ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        row, side = np.divmod(order, 2 * WINDOW)
        each = np.take(dz, row, axis=0)
        each *= np.take(p["a"], side, axis=0)
        grad["e"] = np.zeros_like(p["e"])
        grad["e"][flat[starts]] = np.add.reduceat(each, starts, axis=0)
        for k, g in grad.items():
            g = g / h.dtype.type(n)
            seen[k] += g * g
            p[k] -= rate * g / (np.sqrt(seen[k]) + h.dtype.type(1e-6))


def split(texts: pa.Array) -> tuple[pa.BinaryArray, np.ndarray]:
    """(words of all texts, one after the other; words per text), as `words` gives them, by whole arrays; null: none."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    n = np.zeros(len(texts), np.int64)
    if not len(texts) or texts.buffers()[2] is None:
        return pa.array([], pa.binary()), n
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    data = np.frombuffer(texts.buffers()[2], np.uint8, int(offsets[-1]))[offsets[0] :]
    offsets = offsets - offsets[0]
    solid = (data != 32) & (data - np.uint8(9) > 4)
    edges = offsets[offsets < len(data)]  # where a text starts, what came before is no part of its first word
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[edges] = solid[edges]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offsets[offsets > 0] - 1
    last[edges] = solid[edges]
    starts = np.flatnonzero(first)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)]).astype(np.int32)
    low = data | ((data - np.uint8(65) < 26).view(np.uint8) << 5)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[solid])]), np.diff(np.searchsorted(starts, offsets))


def _slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """The texts in turn, in runs of about ``most`` bytes."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    group = size // most
    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() if len(texts) else []
    for lo, hi in zip(at, [*at[1:], len(texts)]):
        yield texts.slice(lo, hi - lo)


class Classes:
    """Class of each word: its rank among the most frequent, or a hashed class."""

    def __init__(self, frequent: list[bytes]):
        self.frequent = pa.array(frequent, pa.binary())

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray, np.ndarray]:
        """(class of every word, words per text, distinct words, number of each word among these)."""
        found, n = split(texts)
        found = found.dictionary_encode()
        rank = pc.index_in(found.dictionary, value_set=self.frequent)
        other = rank.is_null().to_numpy(zero_copy_only=False)
        ids = rank.fill_null(0).to_numpy().astype(np.int16)
        ids[other] = [CLASSES - HASHED + crc32(w) % HASHED for w in found.dictionary.filter(pa.array(other)).to_pylist()]
        at = found.indices.to_numpy()
        return ids[at], n, found.dictionary, at


def pad(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Classes of texts of n words each, with WINDOW pads before and after each text."""
    out = np.full(len(ids) + 2 * WINDOW * len(n), PAD, np.int16)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)) * 2 * WINDOW + WINDOW, n)] = ids
    return out


def context(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    return padded[at[:, None] + np.array(_OFFSETS)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for texts in _slices(b.column(0), COUNTED):
            found = split(texts)[0].dictionary_encode()
            if len(found):
                n = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
                yield pa.RecordBatch.from_arrays([found.dictionary, pa.array(n, pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows, summed in each task before the shuffle."""
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counted, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


_CODED = "doc_id long, ids binary, others array<struct<word: binary, times: bigint>>"


def _coded(frequent: list[bytes], spell: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(frequent)
        for b in batches:
            done = 0
            for texts in _slices(b.column(1), CODED):
                ids, n, distinct, at = classes.of(texts)
                ends = (2 * np.concatenate([[0], np.cumsum(n)])).astype(np.int32)
                codes = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                others = _spelled(ids, n, distinct, at) if spell else pa.nulls(len(n), pa.list_(pa.struct({"word": pa.binary(), "times": pa.int64()})))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(n)), codes, others], names=["doc_id", "ids", "others"])
                done += len(n)

    return run


def _spelled(ids: np.ndarray, n: np.ndarray, distinct: pa.BinaryArray, at: np.ndarray) -> pa.Array:
    """For each text, (word, times) of its words that have no class of their own."""
    rest = ids >= CLASSES - HASHED
    doc = np.repeat(np.arange(len(n)), n)[rest]
    pairs, times = np.unique(doc * max(len(distinct), 1) + at[rest], return_counts=True)
    doc, word = np.divmod(pairs, max(len(distinct), 1))
    each = pa.StructArray.from_arrays([distinct.take(pa.array(word)), pa.array(times, pa.int64())], names=["word", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32()), each)


def coded(docs: DataFrame, frequent: list[bytes], id_col: str = "doc_id", text_col: str = "text", spell: bool = True) -> DataFrame:
    """(doc_id, ids, others) of every row: its words' classes as 2-byte numbers, and if ``spell``, how often each word occurs
    that has no class of its own. Store it before reading it more than once."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_coded(frequent, spell), _CODED)


def _lengths(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all classes end to end, words per row) of a column of `coded` ids."""
    ends = np.frombuffer(codes.buffers()[1], np.int32, len(codes) + 1, 4 * codes.offset)
    data = codes.buffers()[2]
    ids = np.frombuffer(data, np.uint8, int(ends[-1]))[ends[0] :].view(np.int16) if data is not None else np.zeros(0, np.int16)
    return ids, np.diff(ends) // 2


def targets(padded: np.ndarray, n: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Where the words of the given part stand: every word of every text is in exactly one part, by its place in the text."""
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.flatnonzero(padded != PAD)[place % parts == part]


def _trained(shared, part: int, parts: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, trained = Net.unpack(shared.value), 0
        seen = {k: np.full_like(v, 1e-4) for k, v in net.p.items()}
        x, y = np.zeros((0, 2 * WINDOW), np.int16), np.zeros(0, np.int16)
        for b in batches:
            for codes in _slices(b.column(0), CODED):
                ids, n = _lengths(codes)
                padded = pad(ids, n)
                at = targets(padded, n, part, parts)
                x, y = np.concatenate([x, context(padded, at)]), np.concatenate([y, padded[at]])
                full = len(y) - len(y) % BATCH
                for i in range(0, full, BATCH):
                    net.step(x[i : i + BATCH], y[i : i + BATCH], seen, rate)
                x, y, trained = x[full:], y[full:], trained + full
        if len(y):
            net.step(x, y, seen, rate)
            trained += len(y)
        if trained:
            yield pa.RecordBatch.from_arrays([pa.array([(net.pack() * trained).tobytes()], pa.binary()), pa.array([trained], pa.int64())], names=["sums", "n"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for b in batches:
        for s, k in zip(b.column(0), b.column(1).to_pylist()):
            v = np.frombuffer(s.as_py(), np.float64)
            total = v.copy() if total is None else total + v
            n += k
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["sums", "n"])


#: Sums that come to the driver at most: each has a fixed size, as every task adds up many replicas first.
SUMS = 16


def most_frequent(counts: DataFrame) -> list[bytes]:
    """The words that get classes of their own, by count, ties by their bytes."""
    return [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(CLASSES - HASHED).collect()]


def fit(rows: DataFrame, rounds: int = ROUNDS) -> Net:
    """The network trained on a stored table of `coded` ids."""
    sc, net, narrow = rows.sparkSession.sparkContext, Net.new(), rows.select("ids")
    for k in range(rounds):
        shared = sc.broadcast(net.pack())  # a fixed size, whatever the input
        parts = narrow.mapInArrow(_trained(shared, k, rounds, RATE), "sums binary, n long")
        got = parts.repartition(SUMS).mapInArrow(_summed, "sums binary, n long").collect()
        n = sum(r.n for r in got)
        if n:
            net = Net.unpack(sum(np.frombuffer(bytes(r.sums), np.float64) for r in got) / n)
    return net


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, counts: DataFrame | None = None) -> tuple[Net, list[bytes]]:
    """(network, most frequent words), from all rows of ``docs``; ``counts`` are their word_counts, if at hand.

    A null text has no words; without any word the network stays as it was drawn.
    """
    frequent = most_frequent(word_counts(docs, text_col) if counts is None else counts)
    rows, path = common.table(coded(docs.withColumn("__none", F.lit(None).cast("long")), frequent, "__none", text_col, False), "coded")
    net = fit(rows, rounds)
    common.drop(docs.sparkSession, path)
    return net, frequent


def shares(counts: DataFrame, frequent: list[bytes]) -> DataFrame:
    """(word, share): the log of its part of its hashed class's count, of every word that has no class of its own."""
    top = F.broadcast(counts.sparkSession.createDataFrame([(bytearray(w),) for w in frequent], "word binary"))
    others = counts.join(top, "word", "left_anti").withColumn("bucket", F.crc32("word") % HASHED)
    totals = F.broadcast(others.groupBy("bucket").agg(F.sum("n").alias("total")))  # HASHED rows
    return others.join(totals, "bucket").select("word", F.ln(F.col("n") / F.col("total")).alias("share"))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net.unpack(shared.value)
        for b in batches:
            done = 0
            for codes in _slices(b.column(2), CODED):
                ids, n = _lengths(codes)
                padded = pad(ids, n)
                at = np.flatnonzero(padded != PAD)
                logs = [net.log_prob(context(padded, a), padded[a]) for a in (at[i : i + _STEP] for i in range(0, len(at), _STEP))]
                sums = np.bincount(np.repeat(np.arange(len(n)), n), np.concatenate(logs) if logs else None, len(n)).astype(np.float64)
                mean = np.divide(sums, n, out=np.zeros(len(n)), where=n > 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(n)), b.column(1).slice(done, len(n)), pa.array(n, pa.int64()), pa.array(sums), pa.array(mean)], names=["rid", "doc_id", "n_words", "log_prob", "mean_log_prob"])
                done += len(n)

    return run


def score_coded(rows: DataFrame, net: Net) -> DataFrame:
    """(rid, doc_id, n_words, log_prob, mean_log_prob) from (rid, doc_id, ids): a word's probability is that of its class."""
    shared = rows.sparkSession.sparkContext.broadcast(net.pack())
    return rows.select("rid", "doc_id", "ids").mapInArrow(_scored(shared), "rid long, doc_id long, n_words long, log_prob double, mean_log_prob double")


def score(docs: DataFrame, net: Net, frequent: list[bytes], id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) of every row.

    ``counts`` are the word_counts of the corpus, best a stored table; all words of ``docs`` must be among them. Without them
    a word's probability is that of its class, in one pass without a shuffle.
    A null or wordless text has 0 words and scores 0. Repeated rows each get their row; a null doc_id stays null; an empty
    table gives an empty result (and trains nothing); other columns are ignored.
    """
    rows = coded(docs, frequent, id_col, text_col, counts is not None).withColumn("rid", F.monotonically_increasing_id())
    if counts is None:
        return score_coded(rows, net).drop("rid")
    return _whole(common.cut(rows, "coded"), net, frequent, counts)


def _whole(rows: DataFrame, net: Net, frequent: list[bytes], counts: DataFrame) -> DataFrame:
    """Scores of a stored table of `coded` rows (with rid), each word by its own probability."""
    # the table of words is hashed partition by partition: far fewer rows than the texts have, and neither side is sorted
    within = rows.select("rid", F.inline("others")).join(shares(counts, frequent).hint("shuffle_hash"), "word").groupBy("rid").agg(F.sum(F.col("times") * F.col("share")).alias("within"))
    log_prob = F.col("log_prob") + F.coalesce("within", F.lit(0.0))
    out = score_coded(rows, net).join(within, "rid", "left")
    return out.select("doc_id", "n_words", log_prob.alias("log_prob"), F.when(F.col("n_words") > 0, log_prob / F.col("n_words")).otherwise(0.0).alias("mean_log_prob"))


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`score` of every row by a network trained on all rows; texts are counted once and split into classes once."""
    counts = common.cut(word_counts(docs, text_col), "counts")
    frequent = most_frequent(counts)
    rows = common.cut(coded(docs, frequent, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "coded")
    return _whole(rows, fit(rows), frequent, counts)
