"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pagelog.llm import chunks, common, counts, exact, html, lm, mixing, near, pieces, quality, simhash, tokenfile, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 997}x" for k in range(30_000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog again and again.", "the QUICK brown fox jumps over the lazy dog again and again.", None, "", " \n\t ", "one", "one two", "One two three four",
    LONG, LONG + " z", "É é ÀB straße", "é É àb straße", "a\x1fb\x85c\xa0d", "tab\tsep\nline  two  spaces ▁mark <|endoftext|> </s>", "one", "😀 emoji\x00nul",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k % 4 == 0 else "en", f"s{k % 3}" if k % 5 else None, None if t is None else len(t)) for k, t in enumerate(TEXTS)]
    rows += [(7, "One two three four", "en", "s1", 18), (None, "one", None, "s1", 3), (None, None, None, None, None)]  # a repeated row, rows without an id
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns whose names operators use inside."""
    return docs.withColumns({c: F.lit("x") for c in ("rid", "fp", "name", "n", "size", "copies", "taken", "target", "score", "kept", "file", "h", "block")})


def rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# 1


def naive_print(t):
    w = split(low(t))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def naive_groups(prints, radius=2):
    """ids of equal component for (id, fingerprint) rows"""
    part = list(range(len(prints)))

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    for i, j in product(range(len(prints)), repeat=2):
        if i < j and (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
            part[root(j)] = root(i)
    out = defaultdict(list)
    for k, (i, _) in enumerate(prints):
        out[root(k)].append(i)
    return {k: min((i for i in v if i is not None), default=None) for k, v in out.items()}, [root(k) for k in range(len(prints))]


def test_simhash(docs, none, clashing):
    given = [(r.doc_id, naive_print(r.text)) for r in docs.collect()]
    least, of = naive_groups(given)
    want = Counter((i, f"{fp:016x}", least[of[k]]) for k, (i, fp) in enumerate(given))
    for df in (docs, clashing):
        assert rows(simhash.simhash_groups(df), "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_groups(none).count() == 0


@pytest.mark.parametrize("block", [3, 4096])
@pytest.mark.parametrize("segments", [2, 4, 8])
def test_links_are_exact(spark, monkeypatch, block, segments):
    monkeypatch.setattr(simhash, "BLOCK", block)
    assert len(simhash.offsets(segments, 2)) == {2: 7, 4: 21, 8: 73}[segments]
    r = random.Random(block)
    prints = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(8):
            prints.add(x)
            x ^= 1 << r.randrange(64)  # chains, so that components reach further than the radius
            x ^= 1 << r.randrange(64)
    prints = sorted(prints)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    got = {x.node % (1 << 64): x.root % (1 << 64) for x in common.components(simhash.links(df, segments=segments)).collect()}
    least, of = naive_groups([(x, x) for x in prints])
    sets = defaultdict(set)
    for k, x in enumerate(prints):
        sets[of[k]].add(x)
    mine = defaultdict(set)
    for x in prints:
        mine[got.get(x, x)].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, sets.values()))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(200, 300 + k) for k in range(30)] + [(500, 500)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    part = {n: n for e in edges for n in e}
    while True:
        old = dict(part)
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
        if old == part:
            break
    assert got == part
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_keep_one(spark, docs, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/d")
    stored = spark.read.parquet(f"file://{tmp_path}/d")
    kept = simhash.drop_near_copies(stored)
    assert kept.columns == docs.columns
    given = [(r.doc_id, naive_print(r.text)) for r in docs.collect()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(naive_groups(given)[0].values())
    lone = spark.createDataFrame([(None, "alone here", "", "", 0), (None, "alone here", "", "", 0)], DOCS)
    assert simhash.drop_near_copies(lone).count() == 1 and simhash.drop_near_copies(lone.where("false")).count() == 0


def near_sets(t):
    w = split(low(t))
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_classes(texts, similarity=0.8, radius=64):
    """The class of each text by all pairs, straight from the definition."""
    sets, part, fp = [near_sets(t) for t in texts], list(range(len(texts))), [naive_print(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if len(a & b) >= similarity * len(a | b) and (fp[i] ^ fp[j]).bit_count() <= radius and part[i] != part[j]:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    return part


@pytest.mark.parametrize("many", [1, 4096])
def test_shared_shingles(monkeypatch, many):
    monkeypatch.setattr(near, "MANY", many)
    r = np.random.default_rng(many)
    for bits in (near.BITS, 1 << 14):
        monkeypatch.setattr(near, "BITS", bits)
        u, v = ([np.unique(r.integers(0, 300, int(r.integers(0, 90))).astype(np.uint64)) for _ in range(20)] for _ in range(2))
        side = lambda sets: near.Side(np.zeros(20, np.uint64), np.arange(20), np.array([len(x) for x in sets]), sets)
        x, y = map(np.ravel, np.meshgrid(np.arange(20), np.arange(20), indexing="ij"))
        assert near._shared(side(u), side(v), x, y).tolist() == [len(set(u[i].tolist()) & set(v[j].tolist())) for i, j in zip(x, y)]


def test_near_copies_of_five_words(spark, monkeypatch):
    """Groups as by all pairs, on copies with changed words in chains and stars, with small blocks."""
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghijkl", k=r.randint(2, 8)))
    texts = []
    for g in range(30):
        base = [word() for _ in range(r.choice([30, 80, 200]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 9)):
            other = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 6])):
                other[r.randrange(len(other))] = word()
            texts.append(" ".join(other).upper() if r.random() < 0.2 else " ".join(other))
            base = other if g % 2 else base
    texts += [None, "", " ", "one two", "ONE two", "one two three"]
    want, within = near_classes(texts), near_classes(texts, radius=near.RADIUS)
    monkeypatch.setattr(near, "BLOCK", 50)
    d = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    got = {x.rid: x.label for x in near.classes(common.cut(d, "t")).collect()}
    assert len(got) == len(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    assert [(i, j) for i, j in pairs if got[i] == got[j]] == [(i, j) for i, j in pairs if within[i] == within[j]]  # all links within the radius
    assert not [(i, j) for i, j in pairs if got[i] == got[j] and want[i] != want[j]]  # and no false group
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.9 * sum(want[i] == want[j] for i, j in pairs)


def test_a_large_group_of_near_copies(spark):
    """Hundreds of copies of one text, any two of them alike: one class."""
    r = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(300):
        other = list(base)
        other[r.randrange(120)] = f"x{k}"
        texts.append(" ".join(other))
    d = common.cut(spark.createDataFrame(list(enumerate(texts)), "rid long, text string"), "t")
    assert d.count() == 300 and {x.label for x in near.classes(d).collect()} == {0}
    out = near.drop_near_copies(d.select(F.col("rid").alias("doc_id"), "text", F.lit(1).alias("rid")))
    assert [(x.doc_id, x.rid) for x in out.collect()] == [(0, 1)]


# 2


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenfile.default_tokenizer())
    e = tokenfile._encoder(tokenfile.default_tokenizer())
    r = random.Random(1)
    texts = [t for t in TEXTS if t is not None] + ["".join(r.choices("ab cthe in\n\té漢😀'sll 0.,\x85\x1c\r", k=r.randint(0, 40))) for _ in range(800)]
    texts += ["".join(r.choices("ab  c'd\n\n é×÷ɏɐñ .,!12\u0301²ª\u2019", k=r.randint(0, 60))) for _ in range(800)]
    texts += [" ".join(r.choices(["Don't", "naïve", "1984", "x1y", "end.", "(a)", "“q”", "ÿÀ", "\n", "a\nb", "", "<|endoftext|>"], k=r.randint(0, 20))) for _ in range(400)]
    want = [tk.encode(t, add_special_tokens=False).ids for t in texts]
    for held in (chunks.HELD, 1, 5000):  # what a table forgets is worked out again
        e.table = chunks.Table(e._worked, held, len)
        for lo in range(0, len(texts), 300):
            got = e.encode(pa.array(["", *texts[lo : lo + 300]], pa.string()).slice(1))
            assert [np.frombuffer(g, e.dtype).tolist() for g in got] == want[lo : lo + 300]
        assert held > 1 or len(e.table.new) + len(e.table.old) <= 2 * 512


def test_token_files_start_anew_at_their_bound(spark, docs):
    one, many = (common.scratch_path(spark, "test") for _ in range(2))
    tokenfile.write_tokens(docs, one)
    tokenfile.write_tokens(docs, many, n_rows=3, row=64)
    files = lambda p: spark.read.format("binaryFile").load(p)
    assert files(many).count() > 2 * files(one).count()
    a, b = (sorted(tokenfile.read_digests(spark, p).collect(), key=lambda r: r.start) for p in (one, many))
    assert a == b


def test_token_files(spark, docs, none, clashing):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenfile.default_tokenizer())
    path = common.scratch_path(spark, "test")
    tokenfile.write_tokens(clashing, path)
    got = tokenfile.read_digests(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i))
    ids = lambda t: tk.encode(t or "", add_special_tokens=False).ids + [0]
    want = Counter((r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r in docs.collect() for x in [ids(r.text)])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    some = {r.doc_id: list(r.ids) for r in tokenfile.read_tokens(spark, path, [8, 10]).collect()}
    assert some == {8: ids(LONG), 10: ids(TEXTS[10])}
    assert tokenfile.token_files(none).count() == 0


def test_reader_opens_only_what_is_asked():
    w = tokenfile.Writer(3, np.dtype("<u2"))
    parts = [p for k in range(5) for p in w.add(k, np.arange(k * 10, dtype="<u2").tobytes())] + list(w.finish())
    data = b"".join(p + tokenfile.PAD for p in parts)
    r = tokenfile.Reader(data)
    assert (r.number, r.doc_ids, r.n_tokens().tolist()) == (3, [0, 1, 2, 3, 4], [0, 10, 20, 30, 40])
    broken = bytearray(data)
    at = int(r.start[2])
    broken[at : at + int(r.table[2, 0])] = bytes(int(r.table[2, 0]))
    r = tokenfile.Reader(bytes(broken))
    assert r.ids(1).tolist() == list(range(10)) and r.ids(4).tolist() == list(range(40))  # other frames are not touched
    with pytest.raises(Exception):
        r.ids(2)
    with pytest.raises(ValueError, match="seek table"):
        tokenfile.Reader(data[:-9])
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(np.arange(k * 10, dtype="<u2").tobytes() for k in range(5))  # a plain stream to any other tool


# 3

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this.</div><article><h1>Head &amp; more</h1><p><b>First  line,
of it.<br><p>Second &eacute;&#233; para.</p><div class="comments"><p>Nice, thanks for that.</p></div></article><aside>Side</aside><footer>&copy; x</footer>"""


def test_main_text(spark):
    schema = "page_id long, url string, html string, text string"
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<p", "x"), (1, "u", PAGE, "x")], schema)
    want = "Head & more\nFirst line, of it.\nSecond éé para."
    got = rows(html.main_text(pages), "page_id", "url", "text", "n_chars")
    assert got == Counter({(1, "u", want, len(want)): 2, (2, None, "", 0): 1, (None, "v", "", 0): 1, (3, "w", "", 0): 1})
    assert html.main_text(pages.where("false")).count() == 0


def test_min_cut_is_minimal():
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(1, 8)
        score = [r.uniform(-3, 3) for _ in range(n)]
        joins = [(a, b, r.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]
        cost = lambda x: sum(max(s, 0) if not v else max(-s, 0) for s, v in zip(score, x)) + sum(c for a, b, c in joins if x[a] != x[b])  # noqa: B023, E731
        assert abs(cost(html.min_cut(score, joins)) - min(map(cost, product((False, True), repeat=n)))) < 1e-6


def test_pages_without_hints():
    long = "This is a paragraph of some length, with commas, and it goes on for a while. It says things. " * 3
    page = f"<div><a href=1>Home</a> <a href=2>News</a></div><div><p>{long}</p><p>Short.</p><p>{long}</p></div><div><a href=3>Next</a></div>"
    assert html.extract(page) == f"{long.strip()}\nShort.\n{long.strip()}"


def test_names_of_the_layout_lose_no_page():
    long = " ".join(["This is a paragraph of some length, with commas, and it goes on for a while."] * 4)
    want = f"Title\n{long}"
    for page in (
        f'<div class="content has-sidebar"><article><h1>Title</h1><p>{long}</p></article></div>',
        f'<div class="content no-sidebar"><h1>Title</h1><p>{long}</p></div>',
        f'<div class="layout-with-sidebar post"><h1>Title</h1><p>{long}</p></div>',
        f'<div class="post tags-none"><h1>Title</h1><p>{long}</p></div>',
        f'<div class="container side"><main><h1>Title</h1><p>{long}</p></main></div>',
        f'<div class="widget"><div itemprop="articleBody"><h1>Title</h1><p>{long}</p></div></div>',
        f'<div class="main-header">Site of Things</div><div class="content"><div class="side"><main><h1>Title</h1><p>{long}</p></main></div></div>',
        f'<article><header class="entry-header"><h1>Title</h1></header><p>{long}</p></article>',
        f'<article><h1>Title</h1><p>{long}</p><div class="comments"><article class="comment"><p>{long}</p></article></div></article>',
        f'<article><h1>Title</h1><p>{long}</p></article><div class="comments"><article class="comment"><p>{long}</p></article></div><div class="cookie-notice">{long}</div>',
    ):
        assert html.extract(page) == want, page
    assert html.extract(f'<div class="container side"><p>{long}</p><p>{long}</p></div>') == f"{long}\n{long}"
    assert html.extract(f'<div class="side"><a href="/">{long}</a></div>') == ""


def test_comments_and_formulas():
    long = " ".join(["This is a paragraph of some length, with commas, and it goes on for a while."] * 3)
    comment = "I liked this very much, thank you for writing it, and I wonder what comes next."
    for tail in (
        f'<section class="reader-feedback"><p>{comment}</p><p>{comment}</p></section>', f'<article><p>{comment}</p></article><article><p>{comment}</p></article>',
        f'<div id="comments"><ol><li><p>{comment}</p></li><li><p>{comment}</p></li></ol></div>', f'<div class="discussion"><div>{comment}</div></div>',
    ):
        assert html.extract(f"<article><h1>Title</h1><p>{long}</p>{tail}</article><footer>x</footer>") == f"Title\n{long}", tail
    assert html.extract("<article><p>Let <math><mi>x</mi><annotation>x_1</annotation></math> be a number.</p></article>") == "Let x be a number."


def labelled_page(r):
    """(html without telling elements or names, the article's blocks)"""
    word = lambda: "".join(r.choices("abcdefghijklmno", k=r.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    sentence = lambda: words(r.randint(5, 15)).capitalize() + r.choice([".", ".", ", " + words(3) + "."])
    links = lambda n: "<ul>" + "".join(f"<li><a href=x>{words(r.randint(1, 9))}</a></li>" for _ in range(n)) + "</ul>"
    want, body = [], []
    for _ in range(r.randint(4, 12)):
        kind = r.random()
        text = word().capitalize() + "." if kind < 0.15 else words(3) if kind < 0.3 else " ".join(sentence() for _ in range(r.randint(2, 8)))
        want.append(text)
        body.append(f"<p>{text if kind < 0.9 else '<a href=y>' + text[: len(text) // 2] + '</a>' + text[len(text) // 2 :]}</p>")
    aside = "".join(f"<li>{words(r.randint(2, 14))}</li>" if r.random() < 0.2 else f"<li><a href=z>{words(r.randint(2, 9))}</a></li>" for _ in range(8))
    return f"<div>{links(r.randint(3, 9))}</div><div>{''.join(body)}</div><div><ul>{aside}</ul></div><div>{links(4)}</div>", want


def test_the_cut_mends_labels():
    r = random.Random(6)
    pages = [labelled_page(r) for _ in range(150)]
    weights = html.fit([h for h, _ in pages])
    found, signs, changed = [0, 0, 0], [0, 0, 0], 0
    for h, want in pages:
        page = html.blocks(h)
        sign = [v > 0 for v in html.scores(html.matrix(page), weights)]
        cut = html.label(page, weights)
        changed += sum(a != b for a, b in zip(sign, cut))
        for out, labels in ((found, cut), (signs, sign)):
            got = Counter(b.text for b, k in zip(page, labels) if k)
            hit = sum((got & Counter(want)).values())
            for k, v in enumerate((hit, sum(got.values()), len(want))):
                out[k] += v
    assert changed > 100
    f1 = lambda o: 2 * o[0] / (o[1] + o[2])
    assert found[0] / found[1] > 0.9 and found[0] / found[2] > 0.97 and 1 - f1(found) < 0.6 * (1 - f1(signs)), (found, signs)


def test_very_long_pages():
    page = "<article>" + "".join(f"<p>Paragraph {k} of a long text, which goes on.</p>" for k in range(20_000)) + "</article><footer>x</footer>"
    assert html.extract(page).count("\n") == 19_999


def test_elements_that_are_no_blocks_end():
    a, b, c = (f"{w} paragraph of the article, with commas, and it goes on for a while." for w in ("First", "Second", "Third"))
    for ad in (
        '<ins class="ad">Buy</ins>', "<ins hidden>Buy</ins>", '<amp-ad class="ad"><div>Buy</div></amp-ad>', '<ins class="ad">Buy<ins>this</ins>now</ins>',
        '<x-y style="display:none"><p>Buy</x-y>', '<ins class="ad"/>', '<p><del class="ad">Buy</p>', '<picture class="ad"><source><img></picture></picture>',
    ):
        assert html.extract(f"<article><p>{a}</p>{ad}<p>{b}</p><p>{c}</p></article>") == f"{a}\n{b}\n{c}", ad
    page = f'<article><p>{a} <kbd class="key">Ctrl</kbd> and <ins id="x7">more</ins> text.</p></article>'
    assert html.extract(page) == f"{a} Ctrl and more text."
    assert html.extract(f'<article><p>{a} <ins class="ad">Buy</ins> {b}</p></article>') == f"{a}\n{b}"


@pytest.mark.parametrize("kept", [exact.drop_exact_copies, simhash.drop_near_copies, near.drop_near_copies])
def test_rows_stay_when_files_are_split_anew(spark, tmp_path, kept):
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(30)) for _ in range(40)]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:20])], "doc_id long, text string")
    d.repartition(12, "doc_id").write.parquet(f"file://{tmp_path}/d")
    docs = spark.read.parquet(f"file://{tmp_path}/d")
    out = kept(docs)  # the decision is made; the rows are read with other splits
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert Counter(x.text for x in out.collect()) == Counter(texts)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# 4 and 6


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(9)
    alphabet = "ab cthe in\n\t  ▁é漢😀xyz<s></s>0123456789.,,,   aaaa \u0085"
    return ["", " ", "\n", "\n\n", "▁", "▁▁a", "  a  b  ", "a" * 700, "ab" * 300, "的" * 20, "<0x0A>", " " * 50, "the " * 99] + ["".join(r.choices(alphabet, k=r.randint(0, 50))) for _ in range(600)]


def test_pieces_equal_the_library(odd_texts):
    c = pieces.codec(pieces.default_model())
    assert c.cuts
    for t, (ids, decimal) in zip(odd_texts, c.encode(odd_texts)):
        assert ids == c.sp.encode(t) + [2] and decimal == " ".join(map(str, ids))


def test_counts_equal_the_library(odd_texts):
    sp = pieces.codec(pieces.default_model()).sp
    merger, table = counts._loaded(pieces.default_model())
    for t in odd_texts:
        assert sum(table.of(chunks.marked(t))) == len(sp.encode(t))
    whole = [chunks.MARK + t.replace(" ", chunks.MARK) for t in odd_texts if t]
    assert merger.count(whole).tolist() == [len(sp.encode(t)) for t in odd_texts if t]
    assert [int(merger.count_long([w])[0]) for w in whole[:60]] == merger.count(whole[:60]).tolist()


def test_round_trip(docs, none, clashing):
    sp = pieces.codec(pieces.default_model()).sp
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter((r.doc_id, len(x), sha(" ".join(map(str, x))), sha(sp.decode(x))) for r in docs.collect() for x in [sp.encode(r.text or "") + [2]])
    for df in (docs, clashing):
        assert rows(pieces.round_trip(df), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert pieces.round_trip(none).count() == 0
    back = pieces.decode(pieces.encode(docs.where("doc_id < 8").dropDuplicates(["doc_id"])))
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in enumerate(TEXTS[:8])}


def test_token_counts(docs, none, clashing):
    sp = pieces.codec(pieces.default_model()).sp
    want = Counter((r.doc_id, len((r.text or "").encode()), n, n > 4096) for r in docs.collect() for n in [len(sp.encode(r.text or ""))])
    for df in (docs, clashing):
        assert rows(counts.token_counts(df), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert counts.token_counts(none).count() == 0


def test_tables_forget_and_still_answer():
    asked = []
    t = chunks.Table(lambda parts: [asked.append(p) or p.upper() for p in parts], held=3 * chunks.ENTRY, weigh=len)
    for parts in (["a", "b", "a"], ["c", "a", "d"], ["a" * 300, "e"], list("fghij"), ["a", "j"]):
        assert t.of(parts) == [p.upper() for p in parts]
    assert asked.count("b") == 1 and "a" * 300 not in t.new and "a" * 300 not in t.old
    for k in range(5000):
        assert t.of([f"x{k}"]) == [f"X{k}"]
    assert len(t.new) + len(t.old) <= 8


# 5


def naive_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in held]
        rest = total - sum(3 * sizes[s] for s in held)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in held else share[s] for s in names}
        held |= over


def test_mixing(spark, docs, none, clashing):
    given = docs.collect()
    size = Counter()
    for r in given:
        size[r.source] += len(split(r.text))
    want = naive_targets(size)
    out = mixing.mix_plan(clashing).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r.doc_id, len(split(r.text))) for r in given)
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        assert any(abs(r.target - want[s]) < 1e-6 and r.source_size == size[s] for s in want)
    assert rows(mixing.mix_plan(docs), "doc_id", "taken") == rows(mixing.mix_plan(docs), "doc_id", "taken")
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixed_words_come_near_their_targets(spark):
    r = random.Random(6)
    data = [(k, "w " * r.randint(1, 60), "en", f"s{min(k % 11, 6)}", 0) for k in range(1500)]
    df = spark.createDataFrame(data, DOCS)
    plan = mixing.mix_plan(df)
    by = plan.join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    for x in by:
        assert abs(x.taken - x.target) <= 60  # one document
    copies = {x.doc_id: x.copies for x in plan.collect() if x.copies}
    assert {x.doc_id: x["count"] for x in mixing.mix(df).groupBy("doc_id").count().collect()} == copies
    assert mixing.mix(df).columns == df.columns


def test_copies_have_the_fraction_as_probability(spark):
    seeds, f = 4000, 0.3
    u = spark.range(seeds).select(mixing._draw(F.lit("s"), "x").alias("same"), mixing._draw(F.col("id"), "x").alias("u"))
    assert u.select("same").distinct().count() == 1
    got = u.crossJoin(spark.range(12).withColumnRenamed("id", "r")).groupBy("r").agg(F.avg(mixing.extra(F.col("u"), F.col("r"), F.lit(f))).alias("p")).collect()
    assert len(got) == 12 and all(abs(x.p - f) < 4 * (f * (1 - f) / seeds) ** 0.5 for x in got)
    one = spark.createDataFrame([(k, "a b c", "", f"s{k // 2}", 0) for k in range(400)], DOCS)
    taken = [mixing.mix_plan(one, seed=s).agg(F.sum("copies")).first()[0] for s in ("a", "b")]
    assert taken[0] != 0 and taken[1] != 0


def test_mixing_spreads_a_large_source(spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int"))).alias("text"), F.when(F.col("id") % 3 > 0, "hot").alias("source"))
    out = mixing.mix_plan(many).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(out) == 2 and all(abs(x.taken - x.target) <= 10 for x in out)


def test_columns_of_inner_names_stay(spark):
    cols = ["__rid", "__kept", "__taken", "__copies", "__source", "__s", "__id", "rid", "at", "part", "a.b"]
    d = spark.createDataFrame([(k, f"text number {k % 3} goes here", f"s{k % 2}", *[f"{c}{k}" for c in cols]) for k in range(12)], ["doc_id", "text", "source", *cols])
    for f in (mixing.mix, exact.drop_exact_copies, simhash.drop_near_copies, near.drop_near_copies):
        out = f(d)
        assert out.columns == d.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in cols)
        assert f(d.where("false")).count() == 0


# 7


@pytest.mark.parametrize("block", [4, 8192])
def test_exact_groups(docs, none, clashing, block):
    given = docs.collect()
    groups = defaultdict(list)
    for r in given:
        groups[low(r.text)].append(r.doc_id)
    sha = lambda t: hashlib.sha256(low(t).encode()).hexdigest()
    some = [r for r in given if block > 4 or len(r.text or "") < 1000]
    for df in (docs, clashing):
        df = df if block > 4 else df.where("text is null or length(text) < 1000")
        got = exact.exact_groups(df, block=block).collect()
        best = lambda ids: max((i for i in ids if i is not None), default=None)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((r.doc_id, best(groups[low(r.text)]), len(groups[low(r.text)]), sha(r.text)) for r in some)
        assert sum(r.kept for r in got) == len({low(r.text) for r in some})
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact.exact_groups(none).count() == 0


def test_common_blocks_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(exact, "LEAST", 4)
    monkeypatch.setattr(exact, "COMMON", 8)
    texts = ["same text of many rows"] * 40 + [f"own text {k}" for k in range(10)] + ["same text of many rowz"]
    df = spark.createDataFrame([(k, t, "", "", 0) for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(df, block=8).collect()}
    assert got == {k: (39, 40) if k < 40 else (k, 1) for k in range(51)}


def test_large_groups_of_long_copies(spark, monkeypatch):
    """Every level of pairs has a pair that a third of all rows share, and near copies differ in one late block."""
    monkeypatch.setattr(exact, "LEAST", 5)
    r = random.Random(3)
    long = "".join(r.choices("abcdefgh ", k=300))
    texts = [long] * 30 + [long[:-1] + "Z"] * 20 + ["".join(r.choices("abcdefgh ", k=r.randint(0, 300))) for _ in range(40)] + [None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    best, size = {}, Counter(map(low, texts))
    for k, t in enumerate(texts):
        best[low(t)] = k
    got = {x.doc_id: (x.keep_id, x.group_size) for x in exact.exact_groups(df, block=16).collect()}
    assert got == {k: (best[low(t)], size[low(t)]) for k, t in enumerate(texts)}


def test_exact_copies_go(docs):
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(low(r.text) for r in kept.collect()) == Counter({low(r.text) for r in docs.collect()})


# 8


def naive_base(t):
    t = t or ""
    w = split(t)
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if split(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, none, clashing):
    for df in (docs, clashing):
        for r in quality.judge(df).collect():
            failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert r.base_failed == failed and not (failed and r.kept)
    got = rows(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == Counter((r.doc_id, *naive_base(r.text)) for r in docs.collect())
    assert quality.judge(none).count() == 0 and quality.keep(none).count() == 0


def test_keep_and_drop_odd_rows(docs, clashing):
    """Rows that stay are whole rows of the input, as often as they stand there; nulls are empty texts."""
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    for df in (docs, clashing):
        out = quality.keep(df)
        assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept
    model = toxicity.fit(["good words here", "zzbad words here"] * 20, [0, 1] * 20)
    scores = Counter((r.doc_id, r.predicted) for r in toxicity.score(docs, model).collect())
    for df in (docs, clashing):
        out = toxicity.drop_toxic(df, model)
        assert out.columns == df.columns
        assert Counter(r.doc_id for r in out.collect()) == Counter({k: n for (k, y), n in scores.items() if not y})
    assert toxicity.drop_toxic(docs.where("false"), model).count() == 0 and exact.drop_exact_copies(docs.where("false")).count() == 0


def test_order_of_rules_changes_no_verdict():
    r = random.Random(8)
    texts = [" ".join(r.choices(["word", "other", "###", "12", "a", "naïve...", "\n"], k=r.randint(0, 200))) for _ in range(120)]
    want = [all(not rule(quality.Doc(t)) for rule in quality.RULES.values()) for t in texts]
    order = list(quality.RULES)
    for _ in range(5):
        r.shuffle(order)
        assert [quality.passes(quality.Doc(t), order) for t in texts] == want
    assert sorted(quality.plan(texts)) == sorted(quality.RULES)


def test_cascade_stops_early():
    asked = []
    rules = {"no": lambda d: True, "never": lambda d: asked.append(1) or False}
    assert not quality.passes(quality.Doc("x"), ["no", "never"], rules) and not asked
    assert quality.plan(["x"] * 50, {"slow": lambda d: sum(range(20000)) < 0, "no": lambda d: True})[0] == "no"


def test_quality_on_labels(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    got = quality.judge(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.05 * len(bad)


# 9


def test_log_probabilities_sum_to_one():
    net = lm.Net.new()
    x = np.random.default_rng(1).integers(0, lm.CLASSES, (3, 2 * lm.WINDOW)).astype(np.int32)
    for row in x:
        every = np.arange(lm.CLASSES, dtype=np.int32)
        assert abs(np.exp(net.log_prob(np.repeat(row[None], lm.CLASSES, 0), every)).sum() - 1) < 1e-3


def test_gradient():
    net, r = lm.Net.new(3), np.random.default_rng(2)
    x, y = r.integers(0, lm.CLASSES, (6, 2 * lm.WINDOW)).astype(np.int32), r.integers(0, lm.CLASSES, 6).astype(np.int32)
    for p in net.p.values():
        p[...] = r.normal(0, 0.3, p.shape)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    before = {k: v.copy() for k, v in net.p.items()}
    seen = {k: np.full_like(v, 1e12) for k, v in net.p.items()}
    net.step(x, y, seen, 1e6)  # Adagrad with a huge past: a plain step of rate 1
    step = {k: before[k] - net.p[k] for k in before}
    net.p = {k: v.copy() for k, v in before.items()}
    for k in ("wg", "bg", "b", "a", "bm"):
        at = np.unravel_index(int(np.abs(step[k]).argmax()), step[k].shape)
        loss = []
        for e in (1e-4, -1e-4):
            net.p[k][at] = before[k][at] + e
            loss.append(-net.log_prob(x, y).mean())
        net.p[k][at] = before[k][at]
        assert abs((loss[0] - loss[1]) / 2e-4 - step[k][at]) < 1e-3 * max(1, abs(step[k][at]))


def plain_classes(text, frequent):
    rank = {w: k for k, w in enumerate(frequent)}
    return [rank.get(w, lm.CLASSES - lm.HASHED + zlib.crc32(w) % lm.HASHED) for w in (text or "").encode().lower().split()]


def plain_log_probs(net, ids):
    """Log probability of each class in turn, straight from the definition, in float64."""
    p, out = {k: v.astype(np.float64) for k, v in net.p.items()}, []
    for k, y in enumerate(ids):
        z = p["b"].copy()
        for j, o in enumerate([-2, -1, 1, 2]):
            z += p["a"][j] * p["e"][ids[k + o] if 0 <= k + o < len(ids) else lm.PAD]
        h, g, m = np.tanh(z), y // lm.GROUPS, y % lm.GROUPS
        u, v = h @ p["wg"] + p["bg"], h @ p["wm"][g] + p["bm"][g]
        out.append(u[g] - np.log(np.exp(u).sum()) + v[m] - np.log(np.exp(v).sum()))
    return out


def test_split_equals_words(docs):
    r = random.Random(8)
    texts = [t for (t,) in docs.select("text").collect()] + ["".join(r.choices("aB \n\t\x0b\x0c\r\x1cÉ\xa0", k=r.randint(0, 9))) for _ in range(500)]
    for lo in (0, 1, 7):
        got, n = lm.split(pa.array(texts, pa.string()).slice(lo))
        want = [lm.words(t) for t in texts[lo:]]
        assert n.tolist() == list(map(len, want)) and got.to_pylist() == [w for ws in want for w in ws]


def test_lm_scores(spark, docs, none, clashing, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net, frequent = lm.train(d)
    out = {r.doc_id: r for r in lm.score(d, net, frequent).collect()}
    for r in d.limit(12).collect():
        ids = plain_classes(r.text, frequent)
        want = sum(plain_log_probs(net, ids))
        assert out[r.doc_id].n_words == len(ids) and abs(out[r.doc_id].log_prob - want) < 1e-2 + 1e-4 * abs(want)
    fresh = {r.doc_id: r.mean_log_prob for r in lm.score(d, lm.Net.new(), frequent).collect()}
    assert np.mean([out[k].mean_log_prob for k in out]) > np.mean(list(fresh.values())) + 0.3
    odd = lm.score(docs, net, frequent).where("n_words = 0").collect()
    assert odd and all(r.log_prob == 0 and r.mean_log_prob == 0 for r in odd)
    net, frequent = lm.train(none)
    assert frequent == [] and lm.score(none, net, frequent).count() == 0 and lm.train_and_score(none).count() == 0


def test_lm_scores_of_repeated_rows_and_clashing_columns(docs, clashing):
    got, want = lm.train_and_score(clashing).collect(), Counter((r.doc_id, len(lm.words(r.text))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words) for r in got) == want
    by = defaultdict(set)
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text)
    for r in got:
        by[r.doc_id].add(round(r.log_prob, 3))
    assert all(len(by[k]) <= len(texts[k]) for k in by)  # the same text, the same score


def test_every_word_has_its_own_probability(spark):
    texts = ["a b a b a b " + "rare " * (k % 3) + f"w{k} w{k % 7} x{k % 50}" for k in range(400)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = Counter(w for t in texts for w in (t or "").encode().split())
    found = lm.word_counts(d)
    frequent = [b"a", b"b"]
    shares = {bytes(r.word): r.share for r in lm.shares(found, frequent).collect()}
    buckets = defaultdict(list)
    for w in set(seen) - set(frequent):
        buckets[zlib.crc32(w) % lm.HASHED].append(w)
    assert set(shares) == set(seen) - set(frequent)
    for ws in buckets.values():
        assert abs(sum(np.exp(shares[w]) for w in ws) - 1) < 1e-9
    net = lm.Net.new()
    whole = {r.doc_id: r for r in lm.score(d, net, frequent, counts=found).collect()}
    for r in lm.score(d, net, frequent).collect():
        parts = (texts[r.doc_id] or "").encode().split()
        want = r.log_prob + sum(shares.get(w, 0.0) for w in parts)
        assert abs(whole[r.doc_id].log_prob - want) < 1e-6 and abs(whole[r.doc_id].mean_log_prob - want / max(len(parts), 1)) < 1e-6
    assert len(whole) == len(texts)
    # over the whole vocabulary, the probabilities at a place sum to one
    ids = plain_classes("a w1 b x2 x3", frequent)
    every = {w: zlib.crc32(w) % lm.HASHED + lm.CLASSES - lm.HASHED for w in set(seen) - set(frequent)} | {w: k for k, w in enumerate(frequent)}
    total = sum(np.exp(plain_log_probs(net, [*ids[:2], c, *ids[3:]])[2] + shares.get(w, 0.0)) for w, c in every.items())
    used = set(every.values())
    unused = sum(np.exp(plain_log_probs(net, [*ids[:2], c, *ids[3:]])[2]) for c in range(lm.CLASSES) if c not in used)
    assert abs(total + unused - 1) < 1e-6


def test_training_takes_every_position_once(monkeypatch):
    texts = [" ".join(f"w{k}x{j}" for j in range(k % 23)) for k in range(300)] + [None, "", "one"]
    frequent = sorted({w for t in texts for w in lm.words(t)})[: lm.CLASSES - lm.HASHED]
    taken = []
    monkeypatch.setattr(lm.Net, "step", lambda self, x, y, seen, rate: taken.extend(map(tuple, np.c_[x, y])))

    class Shared:
        value = lm.Net.new().pack()

    tables = [pa.RecordBatch.from_pydict({"doc_id": pa.nulls(len(t), pa.int64()), "text": pa.array(t, pa.string())}) for t in (texts[lo : lo + 50] for lo in range(0, len(texts), 50))]
    tables = [pa.RecordBatch.from_arrays([b.column(1)], names=["ids"]) for b in lm._coded(frequent, False)(iter(tables))]
    n = sum(b.column(1).to_pylist()[0] for k in range(lm.ROUNDS) for b in lm._trained(Shared, k, lm.ROUNDS, lm.RATE)(iter(tables)))
    padded = np.concatenate([[*[lm.PAD] * 2, *plain_classes(t, frequent), *[lm.PAD] * 2] for t in texts])
    at = np.flatnonzero(padded != lm.PAD)
    assert n == len(at) and Counter(taken) == Counter(map(tuple, np.c_[lm.context(padded, at), padded[at]]))


def test_word_counts(docs):
    want = Counter(w for r in docs.collect() for w in (r.text or "").encode().lower().split())
    assert {bytes(r.word): r.n for r in lm.word_counts(docs).collect()} == want


# 10


def test_noisy_or_learns_and_locates(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 6)))
    texts, labels = [], []
    for k in range(600):
        ss = [" ".join(word() for _ in range(8)).capitalize() for _ in range(6)]
        y = int(k % 5 == 0)
        if y:
            ss[r.randrange(6)] += " zzvile " + r.choice(["zzfoul", "zzugly"])
        texts.append(". ".join(ss) + ".")
        labels.append(y)
    docs = spark.createDataFrame([(k, t, "", "", 0) for k, t in enumerate(texts)], DOCS)
    model = toxicity.train(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    for x in toxicity.score(docs, model).collect():
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert x.predicted == labels[x.doc_id] == int(x.score >= 0.5)
        if x.predicted:
            assert "zz" in texts[x.doc_id].lower()[x.worst_start : x.worst_end]
    assert {x.doc_id for x in toxicity.drop_toxic(docs, model).collect()} == {k for k, y in enumerate(labels) if not y}


def test_toxicity_of_odd_rows(spark, docs, none, clashing):
    none_known = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    for df in (docs, clashing):
        out = toxicity.score(df, none_known).collect()
        assert len(out) == docs.count() and all(0 <= x.score < 0.5 for x in out if x.doc_id != 8 and x.doc_id != 9)
    assert toxicity.score(none, none_known).count() == 0 and toxicity.drop_toxic(none, none_known).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, nulls).weights.any() == False  # noqa: E712


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_one_class_scores_all_lengths_alike(spark, labels):
    model = toxicity.fit(["one", "two"][: len(labels)], labels)
    long = "A sentence of words. " * 1000
    d = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id long, text string")
    got = toxicity.score(d, model).collect()
    assert {r.predicted for r in got} == {int(any(labels))} and len({r.score for r in got}) == 1
    assert toxicity.drop_toxic(d, model).count() == (0 if any(labels) else 3)


def test_toxicity_on_held_out_labels(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.toxic for x in out) >= 0.97 * len(out)
    assert sum(x.predicted for x in out if x.toxic) >= 0.8 * sum(x.toxic for x in out)
    assert sum(x.predicted for x in out if not x.toxic) <= 0.01 * len(out)
