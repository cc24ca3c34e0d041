"""SentencePiece encoding and decoding with a table of distinct chunks.

No piece of the model crosses from another character into a white-space mark, nor holds a line break (both are checked when
the model is loaded), so each distinct marked word is segmented once per table and ids are joined back by position.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelog.llm import chunks


#: Chunks segmented in one call of the library.
JOIN = 256


def default_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Ids of whole texts as the library gives them, with an end id; and back."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(len(self.sp))]
        mark = chunks.MARK
        one = self.sp.encode("\n")
        #: Where a piece could cross a cut, whole texts are encoded instead.
        self.cuts = not any("\n" in p or mark in p.lstrip(mark) for p in pieces) and self.sp.encode(" \n") == [self.sp.piece_to_id(mark * 2), *one[1:]] and pieces[one[0]] == mark
        self.end = self.sp.eos_id()
        self.marks = np.array([p[:1] == mark for p in pieces])
        self.mark_id = pieces.index(mark) if mark in pieces else -1
        self.table = chunks.Table(self._segment, held=48 << 20, weigh=lambda v: 140 + len(v[0]) + len(v[1]))

    def _segment(self, parts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as 4-byte numbers, the same in decimal) of each chunk.

        Chunks with one mark are segmented as one text: where a piece starts with a mark, a chunk starts.
        """
        mark, out, easy = chunks.MARK, [None] * len(parts), []
        for k, p in enumerate(parts):
            if p[0] != mark:
                easy.append(k)
            else:
                out[k] = [self.mark_id] if p == mark else self.sp.encode(p[1:].replace(mark, " "))
        for lo in range(0, len(easy), JOIN):
            group = easy[lo : lo + JOIN]
            ids = self.sp.encode(" ".join([parts[k] for k in group]))
            at = np.flatnonzero(self.marks[ids]).tolist()
            for k, i, j in zip(group, at, [*at[1:], len(ids)]):
                out[k] = ids[i + (parts[k][0] == "\n") : j]
        return [(array("i", ids).tobytes(), " ".join(map(str, ids))) for ids in out]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """(ids, ids in decimal joined by one space) of each text."""
        if not self.cuts:
            for t in texts:
                ids = [*self.sp.encode(t), self.end]
                yield ids, " ".join(map(str, ids))
            return
        end = (array("i", [self.end]).tobytes(), str(self.end))
        for lo in range(0, len(texts), 64):
            several = [chunks.marked(t) for t in texts[lo : lo + 64]]
            known = iter(self.table.of([p for parts in several for p in parts]))
            for parts in several:
                got = [*islice(known, len(parts)), end]
                yield array("i", b"".join([g[0] for g in got])).tolist(), " ".join([g[1] for g in got])

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _coded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_model())
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for lo in range(0, b.num_rows, 256):
                for ids, decimal in c.encode([t or "" for t in b.column(1).slice(lo, 256).to_pylist()]):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(decimal.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_model())
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = [x for x, _ in c.encode([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_model())
        for b in batches:
            texts = [c.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null or empty text has the end id only."""
    return _narrow(docs, id_col, text_col).mapInArrow(_encoded(model), "doc_id long, ids array<int>")


def decode(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(doc_id, text) of every row of ids; null ids give an empty text."""
    return ids.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(_decoded(model), "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, in one pass without a shuffle.

    A null text counts as empty. Repeated rows each get their row; a null doc_id stays null; an empty table gives an empty
    result; other columns are ignored.
    """
    return _narrow(docs, id_col, text_col).mapInArrow(_coded(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
