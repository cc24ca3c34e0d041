"""Token counts by rank-synchronous merging in numpy arrays.

A batch's distinct chunks are laid end to end as one array of symbols. In each round every chunk merges the pair of lowest
rank that it still has, all chunks at once; surviving symbols are the tokens. A pair that occurs several times in a chunk is
merged everywhere at once, unless a merge makes a pair of lower rank still, which must then come first: such a chunk merges
only its leftmost pair in that round, as one after the other would.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelog.llm import chunks
from pagelog.llm.pieces import default_model

LIMIT = 4096
#: Characters that are merged together, about as many as a core's cache holds; long chunks alone.
STEP = 1 << 14
_NONE = np.iinfo(np.int32).max


class Merger:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in normal}
        if any("\n" in p or chunks.MARK in p.lstrip(chunks.MARK) for p in text.values()):
            raise ValueError("a piece of this model crosses white space: texts can't be cut into chunks")
        if not all(sp.is_byte(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError("this model has no byte fallback")
        # Symbols: every piece, every character of a piece, and four for other characters by their length in UTF-8.
        symbols = {p: k for k, p in enumerate(text.values())}
        for c in sorted({c for p in text.values() for c in p} - set(symbols)):
            symbols[c] = len(symbols)
        whole = set(text.values())
        other = len(symbols)
        self.cost = np.array([1 if s in whole else len(s.encode()) for s in symbols] + [1, 2, 3, 4], np.int64)
        self.of_char = np.empty(0x110000, np.int32)
        for lo, hi, k in ((0, 0x80, 0), (0x80, 0x800, 1), (0x800, 0x10000, 2), (0x10000, 0x110000, 3)):
            self.of_char[lo:hi] = other + k
        for s, k in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k
        by_score = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        rank = {text[i]: r for r, i in enumerate(by_score)}
        self.k = other + 4
        pairs = sorted((symbols[p[:j]] * self.k + symbols[p[j:]], rank[p], symbols[p]) for p in whole for j in range(1, len(p)) if p[:j] in symbols and p[j:] in symbols)
        self.keys, self.ranks, self.made = self._hashed(pairs)

    def _hashed(self, pairs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An open-addressing table of the pairs, an eighth full at most; the last slot of all stays free."""
        self.bits = max(4, (8 * len(pairs)).bit_length())
        size = 1 << self.bits
        keys, ranks, made = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        for key, rank, symbol in pairs:
            at = int(self._slot(np.array([key], np.int64))[0])
            while keys[at] >= 0:
                at = (at + 1) % size
            keys[at], ranks[at], made[at] = key, rank, symbol
        return keys, ranks, made

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; _NONE where it is no pair."""
        key = left.astype(np.int64) * self.k + right
        at = self._slot(key)
        got = self.keys[at]
        more = np.flatnonzero((got != key) & (got >= 0))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            got = self.keys[at[more]]
            more = more[(got != key[more]) & (got >= 0)]
        return self.ranks[at], self.made[at]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each chunk: one merge per chunk and round."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        out, ids = np.zeros(len(texts), np.int64), np.arange(len(texts))
        sym = self.of_char[np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")]
        ids, size = ids[size > 0], size[size > 0]
        rank, made = self._pairs(sym, np.repeat(np.arange(len(size)), size))
        while True:
            # Chunks lie end to end; prv and nxt step over symbols that were merged away.
            n = len(sym)
            if not n:
                return out
            start = np.cumsum(size) - size
            stop, seq = start + size, np.repeat(np.arange(len(size)), size)
            nxt, prv, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
            while True:
                least = np.minimum.reduceat(rank, start)
                live = least != _NONE
                if np.count_nonzero(live) * 4 <= len(live) * 3:
                    break
                least[~live] = -1
                at = np.flatnonzero(rank == np.repeat(least, size))
                s = seq[at]
                first = np.ones(len(at), bool)
                first[1:] = s[1:] != s[:-1]
                at, s = at[first], s[first]
                gone = nxt[at]
                sym[at] = made[at]
                alive[gone] = False
                rank[gone] = _NONE
                after = nxt[gone]
                nxt[at] = after
                has = after < stop[s]
                rank[at] = _NONE
                a, b = at[has], after[has]
                prv[b] = a
                rank[a], made[a] = self._find(sym[a], sym[b])
                p = prv[at]
                has = p >= start[s]
                a, p = at[has], p[has]
                rank[p], made[p] = self._find(sym[p], sym[a])
            done = np.add.reduceat(np.where(alive, self.cost[sym], 0), start)
            out[ids[~live]] += done[~live]
            keep = alive & live[seq]
            size = np.add.reduceat(keep.astype(np.int64), start)[live]
            ids, sym, rank, made = ids[live], sym[keep], rank[keep], made[keep]

    def count_long(self, texts: list[str]) -> np.ndarray:
        """Tokens of each chunk: all occurrences of a chunk's lowest pair in a round, for long chunks."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros(len(texts), np.int64)
        sym = self.of_char[np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")]
        seq = np.repeat(np.arange(len(texts)), sizes)
        rank, made = self._pairs(sym, seq)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, starts)
            long = np.diff(np.r_[starts, len(sym)])
            least_at = np.repeat(least, long)
            ended = least_at == _NONE
            if ended.any():
                np.add.at(out, seq[ended], self.cost[sym[ended]])
                live = ~ended
                sym, seq, rank, made, least_at = sym[live], seq[live], rank[live], made[live], least_at[live]
                if not len(sym):
                    break
            sel = self._apart(rank == least_at)
            new = self._merge(sym, seq, rank, made, sel)
            # A chunk whose several merges made a pair of lower rank goes back, and merges its leftmost pair only.
            fell = np.unique(new[1][new[2] < new[4]])
            if len(fell):
                at = np.flatnonzero(sel)
                first = np.r_[True, seq[at][1:] != seq[at][:-1]]
                redo = np.isin(seq[at], fell) & ~first
                if redo.any():
                    sel[at[redo]] = False
                    new = self._merge(sym, seq, rank, made, sel)
            sym, seq, rank, made = new[:4]
        return out

    def _pairs(self, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            r, m = self._find(sym[:-1], sym[1:])
            rank[:-1] = np.where(seq[:-1] == seq[1:], r, _NONE)
            made[:-1] = m
        return rank, made

    @staticmethod
    def _apart(sel: np.ndarray) -> np.ndarray:
        """Of pairs that overlap, every other one from the left."""
        at = np.flatnonzero(sel)
        if len(at) > 1 and (np.diff(at) == 1).any():
            start = np.r_[True, np.diff(at) != 1]
            run = np.maximum.accumulate(np.where(start, at, 0))
            sel = sel.copy()
            sel[at[(at - run) % 2 == 1]] = False
        return sel

    def _merge(self, sym: np.ndarray, seq: np.ndarray, rank: np.ndarray, made: np.ndarray, sel: np.ndarray) -> tuple:
        """(symbols, chunks, ranks, merged symbols, rank merged at each pair that is new and else -1) after merging ``sel``."""
        at = np.flatnonzero(sel)
        merged = sym.copy()
        merged[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        was = np.full(len(sym), -1, np.int32)
        was[at] = rank[at]
        was, s, q, r, m = was[keep], merged[keep], seq[keep], rank[keep], made[keep]
        here = np.flatnonzero(was >= 0)
        near = np.zeros(len(s), bool)
        near[here] = True
        near[here[here > 0] - 1] = True
        touched = np.flatnonzero(near)
        bar = np.full(len(s), -1, np.int32)
        nxt = np.minimum(touched + 1, len(s) - 1)
        same = (touched + 1 < len(s)) & (q[touched] == q[nxt])
        nr, nm = self._find(s[touched], s[nxt])
        r[touched] = np.where(same, nr, _NONE)
        m[touched] = nm
        bar[touched] = np.where(same, np.maximum(was[touched], np.where(same, was[nxt], -1)), -1)
        return s, q, r, m, bar

    def table(self) -> chunks.Table:
        return chunks.Table(self._worked, held=64 << 20)

    def _worked(self, parts: list[str]) -> Iterator[int]:
        mark = chunks.MARK
        whole = [p if p[:1] in (mark, "\n") else mark + p for p in parts]
        group, n = [], 0
        for w in whole:
            if len(w) > chunks.LONG or n > STEP:
                if group:
                    yield from self.count(group).tolist()
                group, n = [], 0
            if len(w) > chunks.LONG:
                yield from self.count_long([w]).tolist()
                continue
            group.append(w)
            n += len(w)
        if group:
            yield from self.count(group).tolist()


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Merger, chunks.Table]:
    m = Merger(path)
    return m, m.table()


def _counted(path: str | None, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = _loaded(path or default_model())
        for b in batches:
            n, size = [], pa.compute.binary_length(b.column(1).cast(pa.binary())).fill_null(0).to_pylist()
            for lo in range(0, b.num_rows, 256):
                parts = [chunks.marked(t or "") for t in b.column(1).slice(lo, 256).to_pylist()]
                known = iter(table.of([p for ps in parts for p in ps]))
                n += [sum(islice(known, len(ps))) for ps in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, in one pass without a shuffle.

    Counts are those of the model's library without begin or end ids. A null or empty text has 0 bytes and tokens. Repeated
    rows each get their row; a null doc_id stays null; an empty table gives an empty result; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_counted(model, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
