"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are estimated on a sample; rules then run in order of rejection per cost, and a document
leaves at the first rule that rejects it. The order changes the time taken and nothing else: the verdict is that no rule
rejects.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of the lowest hashes of doc_id on which costs and rejection rates are estimated. It decides no verdict.
SAMPLE = 400
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
_LETTER = re.compile(r"[^\W\d_]")


class Doc:
    """Features of a text, each worked out when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # on bytes, this splits at the six ASCII white-space characters

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\n\v\f\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        if len(w) < 4:
            return 0
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen = Counter(windows)
        hit = np.zeros(len(w) + 2, bool)
        again = np.fromiter((seen[x] > 1 for x in windows), bool, len(windows))
        for k in range(3):
            hit[k : k + len(windows)] |= again
        return int(hit.sum())

    @cached_property
    def n_lettered(self) -> int:
        return sum(1 for w in self.words if w.isalpha() or _LETTER.search(w.decode()))


Rule = Callable[[Doc], bool]

#: True: the document fails. Thresholds are those that published rule sets for web text use, or close to them.
RULES: dict[str, Rule] = {
    "too_short": lambda d: d.n_words < MIN_WORDS,
    "repeats": lambda d: 100 * d.n_repeat_words > 50 * d.n_words,
    "symbols": lambda d: 10 * d.n_symbols > d.n_words,
    "word_length": lambda d: not 3 * d.n_words <= d.word_chars <= 10 * d.n_words,
    "dup_lines": lambda d: 10 * d.n_dup_lines > 4 * len(d.lines),
    "letters": lambda d: 10 * d.n_lettered < 7 * d.n_words,
    "ellipses": lambda d: 10 * sum(x.rstrip().endswith(("...", "…")) for x in d.lines) > 3 * len(d.lines),
    "bullets": lambda d: 10 * sum(x.lstrip().startswith(("•", "- ", "* ")) for x in d.lines) > 9 * len(d.lines),
}
BASE = ("too_short", "repeats")


def plan(texts: list[str], rules: dict[str, Rule] = RULES) -> list[str]:
    """Names of ``rules`` by rejection per second, as measured on ``texts``; ties in the order given."""
    gain = {}
    for name, rule in rules.items():
        docs = [Doc(t) for t in texts]
        began = time.perf_counter()
        rejected = sum(map(rule, docs))
        gain[name] = (rejected + 0.5) / (len(docs) + 1) / (time.perf_counter() - began + 1e-6)
    return sorted(rules, key=lambda n: -gain[n])


def passes(doc: Doc, order: list[str], rules: dict[str, Rule] = RULES) -> bool:
    return not any(rules[n](doc) for n in order)


def sample(docs: DataFrame, id_col: str, text_col: str, rows: int = SAMPLE) -> list[str]:
    """Texts of the rows with the lowest hashes of ``id_col``; hashes are compared first, so texts of these rows only move."""
    h = F.xxhash64(F.col(id_col).cast("string"))
    low = docs.select(h.alias("h")).orderBy("h").limit(rows).collect()
    if not low:
        return []
    got = docs.where(h <= F.lit(low[-1].h)).select(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).limit(rows).collect()
    return [r[0] for r in got]


def _judged(order: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                d = Doc(t or "")
                failed = any(RULES[n](d) for n in BASE)
                rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, not failed and passes(d, order)))
            cols = list(zip(*rows)) if rows else [()] * 7
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.bool_()) for c in cols[5:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return run


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    A null text has no words, so base_failed. Repeated rows each get their row; a null doc_id stays null; an empty table
    gives an empty result; other columns are ignored. Documents that pass the base rules go through the cascade of the rest.
    """
    order = [n for n in plan(sample(docs, id_col, text_col)) if n not in BASE]
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_judged(order), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def _kept(order: list[str], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([passes(Doc(t or ""), order) for t in b.column(at).cast(pa.string()).to_pylist()], pa.bool_()))

    return run


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, that no rule rejects; features that no rule reached are never worked out."""
    return docs.mapInArrow(_kept(plan(sample(docs, id_col, text_col)), docs.columns.index(text_col)), docs.schema)
