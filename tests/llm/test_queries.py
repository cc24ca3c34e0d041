"""Registered queries against SQL, and the pipeline against a plain version of its stages."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelog.llm import oracle, pieces, queries, tokenfile, toxicity
from tests.duck import same
from tests.llm.test_operators import low, naive_groups, naive_print, near_classes, split


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), sf_dir, oracle.ORACLE[name])


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_simhash_query(spark, sf_dir, table):
    prints = [(k, naive_print(t)) for k, t in sorted(table.items())]
    least, part = naive_groups(prints)
    want = {k: (f"{fp:016x}", least[p]) for (k, fp), p in zip(prints, part)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, sf_dir).collect()} == want


def test_token_file_query(spark, sf_dir, table):
    from tokenizers import Tokenizer

    tk, at, want = Tokenizer.from_file(tokenfile.default_tokenizer()), 0, {}
    for k, t in sorted(table.items()):
        ids = np.array([*tk.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want[k] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_files(spark, sf_dir).collect()} == want


def test_piece_queries(spark, sf_dir, table):
    sp = pieces.codec(pieces.default_model()).sp
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {k: sp.encode(t) for k, t in table.items()}
    want = {k: (len(t.encode()), len(ids[k]), len(ids[k]) > 4096) for k, t in table.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op4_token_counts(spark, sf_dir).collect()} == want
    want = {k: (len(x) + 1, sha(" ".join(map(str, [*x, sp.eos_id()]))), sha(sp.decode([*x, sp.eos_id()]))) for k, x in ids.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_pieces(spark, sf_dir).collect()} == want


def test_score_queries(spark, sf_dir, table):
    """Every row has its score; the scores themselves are tested against plain versions of the models."""
    lm = {r.doc_id: r for r in queries.op9_lm_scores(spark, sf_dir).collect()}
    assert set(lm) == set(table) and all(lm[k].n_words == len(split(low(t))) for k, t in table.items())
    tox = {r.doc_id: r for r in queries.op10_toxicity(spark, sf_dir).collect()}
    assert set(tox) == set(table)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in tox.items())


def test_main_text_query(spark, sf_dir):
    """The article of the test pages as their own markup tells it, read here by another parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.out, self.now = 0, [], []

        def end(self):
            if t := re.sub(r"\s+", " ", "".join(self.now)).strip():
                self.out.append(t)
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.now.append(" ")
            elif tag != "b":
                self.end()
            self.inside += tag == "article"

        def handle_endtag(self, tag):
            if tag != "b":
                self.end()
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.now.append(data)

    def article(page):
        a = Article()
        a.feed(page or "")
        a.close()
        return "\n".join(a.out)

    d = sf_dir.replace("0.001", "0.01")
    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op3_main_text(spark, d).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, further columns; and no rows, or no labels, at all."""
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, rid long, size string, `__rid` int"
    rows = [(k if k % 7 else None, f"text number {k % 9} of this table. It says {k % 5}." if k % 4 else None if k % 8 else "", None, None if k % 3 else "s", None, k, "x", 1) for k in range(40)]
    rows += rows[:10]
    for tag, some, labels in (("odd", rows, [(3, None), (None, 1), (5, 0), (6, 1)]), ("empty", [], [(1, 0)]), ("unlabelled", rows, [])):
        d = f"file://{tmp_path}/{tag}"
        spark.createDataFrame(some, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, docs, d)
            assert out.columns == docs.columns
            out.write.parquet(f"{d}/{name}")
            docs = spark.read.parquet(f"{d}/{name}")
        left = docs.collect()
        assert p.STAGES[-1][1](spark, docs, d).count() == len(left) == p.run(spark, d).count()
        assert bool(left) == bool(some) and len({low(r.text) for r in left}) <= 46


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 6)))
    texts, toxic = [], []
    for k in range(300):
        y = k % 6 == 0
        texts.append(". ".join(" ".join(word() for _ in range(12)) + (" zzvile" if y and j == 1 else "") for j in range(4)))
        toxic.append(int(y))
    for k in range(20):  # exact copies, with other letter case, and near copies
        texts += [texts[3 * k + 1].upper(), texts[3 * k + 2] + " extra"]
        toxic += [toxic[3 * k + 1], toxic[3 * k + 2]]
    d = f"file://{tmp_path}"
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{d}/labels.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen[name] = docs
        if name != p.STAGES[-1][0]:
            assert sorted(docs.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
    left = {x.doc_id: x.text for x in seen["toxicity"].collect()}
    assert set(left) == {k for k, y in enumerate(toxic) if not y}
    best = {}
    for k, t in left.items():
        best[low(t)] = max(k, best.get(low(t), -1))
    left = {k: left[k] for k in best.values()}
    assert {x.doc_id for x in seen["exact_dedup"].collect()} == set(left)
    ids = sorted(left)
    least = {}
    for k, group in zip(ids, near_classes([left[k] for k in ids])):
        least.setdefault(group, k)
    assert {x.doc_id for x in seen["simhash"].collect()} == set(least.values())
    assert not set(least.values()) & {301 + 2 * k for k in range(20)}  # every near copy went
    mixed = seen["mixing"].collect()
    assert {x.doc_id for x in mixed} <= set(least.values())
    sp = pieces.codec(pieces.default_model()).sp
    assert sorted((x.doc_id, x.n_tokens) for x in docs.collect()) == sorted((x.doc_id, len(sp.encode(x.text)) + 1) for x in mixed)
    assert sorted(map(tuple, p.run(spark, d).collect())) == sorted(map(tuple, docs.collect()))
    assert toxicity.THRESHOLD == 0.5
