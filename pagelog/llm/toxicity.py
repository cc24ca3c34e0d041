"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in hashed features of its distinct words (the word and
its first letters); the document's is the noisy-or of its sentences. Only document labels train it, yet each sentence gets
its own probability, which locates the offending ones.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelog.llm import chunks

#: Labelled documents that the model is fitted on at most, those of the lowest hashes of doc_id. All rows are scored.
TRAINING_ROWS = 8_000
THRESHOLD = 0.5
FOLDS = 5
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6)
#: Features must stand in so many training documents; SPARSE is the penalty on the sum of absolute weights.
LEAST_DOCS = 3
ROUNDS, RATE, SPARSE, START = 180, 0.05, 1e-4, -5.0

_SENTENCE = re.compile(r"[.!?\n]+")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence that holds more than white space; one empty one if there is none."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.end()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out or [(0, 0)]


def features(word: str) -> list[int]:
    """Feature numbers of a lower-cased word without what is no letter at its ends."""
    w = _EDGE.sub("", word)
    if not w:
        return []
    out = [crc32(w.encode()) % BUCKETS]
    for n in PREFIXES:
        if len(w) >= n:
            out.append(crc32(b"%d:%b" % (n, w[:n].encode())) % BUCKETS)
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: The score of every document, whatever its sentences, where the labels show one class only.
    constant: float | None = None

    def of_words(self, words: list[str]) -> list[float]:
        of = self.plain.__getitem__
        return [sum(map(of, features(w))) for w in words]

    @cached_property
    def plain(self) -> list[float]:
        return self.weights.tolist()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "plain"}


def fit(texts: list[str], labels: list[int]) -> Model:
    """Full-batch proximal Adam on the noisy-or likelihood. With one class only, every document gets a constant far from the threshold."""
    y = np.array(labels, bool)
    if not len(y) or y.all() or not y.any():
        bias = 5.0 if len(y) and y.all() else START
        return Model(np.zeros(BUCKETS, np.float32), bias, float(1 / (1 + np.exp(-bias))))
    # Word numbers of each sentence, and features of each word, end to end in typed arrays: a few bytes for each.
    number: dict[str, int] = {}
    flat, sizes, per_doc, feat_, per_word = array("i"), array("i"), array("i"), array("i"), array("i")
    for t in texts:
        low = t.lower()
        spans = sentences(low)
        per_doc.append(len(spans))
        for lo, hi in spans:
            ids = sorted({number.setdefault(w, len(number)) for w in low[lo:hi].split()})
            sizes.append(len(ids))
            flat.extend(ids)
    for w in number:
        fs = features(w)
        per_word.append(len(fs))
        feat_.extend(fs)
    n_words, n_sentences = len(number), len(sizes)
    del number
    feat, flat_ = np.frombuffer(feat_, np.int32), np.frombuffer(flat, np.int32)
    feat_word, sent = np.repeat(np.arange(n_words, dtype=np.int32), per_word), np.repeat(np.arange(n_sentences, dtype=np.int32), sizes)
    doc = np.repeat(np.arange(len(y), dtype=np.int32), per_doc)
    usable = _document_counts(flat_, doc[sent], feat, np.array(per_word, np.int64)) >= LEAST_DOCS
    w, b = np.zeros(BUCKETS), START
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        by_word = np.bincount(feat_word, w[feat], n_words)
        z = np.clip(b + np.bincount(sent, by_word[flat_], n_sentences), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.clip(np.bincount(doc, -np.logaddexp(0, z), len(y)), -50, -1e-9)  # log of no sentence being toxic
        slope = np.where(y, 1 / np.expm1(-clean), -1.0)  # of the log likelihood, in each sentence's z, over p
        g = slope[doc] * p / len(y)
        gw = np.bincount(feat, np.bincount(flat_, g[sent], n_words)[feat_word], BUCKETS) * usable
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
        pace = RATE / (np.sqrt(v / fix2) + 1e-4)
        w += pace * (m / fix)
        w = np.sign(w) * np.maximum(np.abs(w) - pace * SPARSE, 0)
        b += RATE * (mb / fix) / (np.sqrt(vb / fix2) + 1e-4)
    return Model(w.astype(np.float32), float(b))


def _document_counts(words: np.ndarray, doc: np.ndarray, feat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """In how many documents each feature stands."""
    start = np.cumsum(size) - size
    out = np.zeros(BUCKETS, np.int64)
    edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    for lo, hi in zip(edges, [*edges[1:], len(doc)]):
        w = np.unique(words[lo:hi])
        n = size[w]
        at = np.repeat(start[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[np.unique(feat[at])] += 1
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    """Fit on labelled rows outside the held-out fold, TRAINING_ROWS of them at most. Rows without a label teach nothing."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).dropna()
    known = known.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("__y").alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("__doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    # `known` has TRAINING_ROWS rows at most, whatever the input
    got = texts.join(F.broadcast(known), F.col("__doc") == F.col("__id")).select("__doc", "__text", "__y").limit(rows).collect()
    got.sort(key=lambda r: (r[0], r[1]))
    texts, labels = [r[1] for r in got], [r[2] for r in got]
    del got
    return fit(texts, labels)


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that never train: a null doc_id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _scored(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        table = chunks.Table(m.of_words, held=64 << 20)
        for b in batches:
            score, start, end, worst = [], [], [], []
            for lo in range(0, b.num_rows, 64):
                several = [(t or "").lower() for t in b.column(1).slice(lo, 64).to_pylist()]
                spans = [sentences(t) for t in several]
                words = [[set(t[i:j].split()) for i, j in ss] for t, ss in zip(several, spans)]
                known = dict.fromkeys(w for ws in words for s in ws for w in s)
                known = dict(zip(known, table.of(list(known))))
                for ws, ss in zip(words, spans):
                    z = np.array([sum(map(known.__getitem__, s)) for s in ws]) + m.bias
                    k = int(z.argmax())
                    score.append(float(-np.expm1(-np.logaddexp(0, np.clip(z, -30, 30)).sum())) if m.constant is None else m.constant)
                    worst.append(float(1 / (1 + np.exp(-np.clip(z[k], -30, 30)))))
                    start.append(ss[k][0])
                    end.append(ss[k][1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(worst, pa.float64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "score", "worst_score", "worst_start", "worst_end"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, worst_score, worst_start, worst_end) of every row, in one pass without a shuffle.

    The last three tell the sentence that is likeliest toxic, as offsets into the lower-cased text. A null or empty text is
    one empty sentence. Repeated rows each get their row; a null doc_id stays null and is not held out; an empty table gives
    an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, whatever the input
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = narrow.mapInArrow(_scored(shared), "doc_id long, score double, worst_score double, worst_start int, worst_end int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_score", "worst_start", "worst_end")


def _clean(model, at: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def narrow() -> Iterator[pa.RecordBatch]:
            for b in batches:
                held.append(b)
                yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(at).cast(pa.string())], names=["doc_id", "text"])

        for got in _scored(model)(narrow()):  # one batch for each, with one table for all
            b = held.pop()
            yield b.filter(pa.array([s < THRESHOLD for s in got.column(1).to_pylist()], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose score is below the threshold; one pass without a shuffle or join."""
    return docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)), docs.schema)
