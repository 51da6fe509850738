"""Each operator against a plain version, on rows with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import ann, bpe, common, components, exact_dedup, html_text, jaccard_join, langid, line_dedup, link_counts, lm, mixing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    line = "a shared line of well over forty characters, seen again and again"
    rows = [(0, None, None, None), (1, "", "en", "s"), (2, " \t\n", "en", "s"), (3, "one", "en", "b"), (4, "One two  three", "en", "b"), (5, "12 34", None, "b")]
    base = [word() for _ in range(150)]
    for i in range(10, 30):  # near copies
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(150)] = word()
        rows.append((i, " ".join(w), "xx", "a"))
    for i in range(30, 50):
        rows.append((i, "\n".join([line if i % 2 else line.upper() + " ", *(" ".join(word() for _ in range(rng.randint(3, 40))) for _ in range(3))]), "yy", rng.choice("abc")))
    rows += [(60 + i, "same\ttext here", "xx", "c") for i in range(5)] + [(70, "same  text\nhere", "yy", "c")]
    rows += [(80, "long " * 30_000, "xx", "c"), (81, "x" * 3000, "xx", "c")]
    return [(i, t, lang, s, 0) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"k": F.lit("x"), "n": F.lit(1), "__v": F.lit("y")}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# --- common ---------------------------------------------------------------------------------------------------


def test_hash_words_matches_words(monkeypatch):
    monkeypatch.setattr(common, "WINDOW", 64)
    texts = [None, "", " a b ", "Ab aB AB é É", "x" * 500 + " y", "a\nb\tc\x0bd"]
    h, n = common.hash_words(texts)
    flat = [w for t in texts for w in words(t)]
    assert n.tolist() == [len(words(t)) for t in texts]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 7), (10, 11), (None, 3)] + [(i, i + 1) for i in range(100, 140)], "a long, b long")
    got = {r["d"]: r["comp"] for r in components.components(edges).collect()}
    assert got[9] == got[5] == 3 and got[7] == 7 and got[11] == 10 and got[140] == 100
    assert components.components(edges.limit(0)).count() == 0


# --- 1 --------------------------------------------------------------------------------------------------------


def plain_components(rows, k, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (1, 60)])
@pytest.mark.parametrize("short", [48, 2])
def test_jaccard(docs, rows, k, num, short, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", short)  # 2: lists in blocks
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs, k, num, 100).collect()}
    assert got == plain_components(rows, k, num, 100)


def test_jaccard_small_sets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.sample("a b c d e f g h i j k l m n o p q r s t u v".split(), rng.randint(1, 22))), None, None, 0) for i in range(300)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA), 1, 80, 100).collect()}
    assert got == plain_components(rows, 1, 80, 100)


def test_jaccard_edges(spark, docs, none):
    assert jaccard_join.join(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f", None, None, 0), (1, "a b c d e f", None, None, 0), (1, "a b c d e f", None, None, 0), (2, "A b c d e f", None, None, 0)], SCHEMA)
    got = sorted(map(tuple, jaccard_join.join(odd).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]
    kept = jaccard_join.keep_one(odd)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, None] and kept.columns == odd.columns


def plain_links(rows, k, num, den):
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links = lambda x, y: den * len(x & y) >= num * len(x | y) and bool(x and y)
    live = [i for i, r in enumerate(rows) if r[0] is not None]
    return [None if r[0] is None else sum(links(sets[i], sets[j]) for j in live if j != i) for i, r in enumerate(rows)]


@pytest.mark.parametrize("short", [48, 2])
def test_jaccard_counts_every_link(spark, rows, short, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    odd = [*rows, (10, "its own words of another text", None, None, 0), (3, rows[6][1], None, None, 0), (3, rows[7][1], None, None, 0), (None, rows[6][1], None, None, 0)]
    want = plain_links(odd, 5, 60, 100)
    got, pairs = jaccard_join.graph(spark.createDataFrame(odd, SCHEMA), 5, 60, 100)
    got = got.collect()
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == Counter((r[0], n) for r, n in zip(odd, want)) and max(x or 0 for x in want) > 5
    copies = Counter(r["set"] for r in got if r["doc_id"] is not None and r["n_shingles"])
    total = sum(2 * copies[r["p"]] * copies[r["q"]] for r in pairs.collect()) + sum(c * (c - 1) for c in copies.values())
    assert total == sum(x or 0 for x in want)


@pytest.mark.parametrize("block", [512, 3])
@pytest.mark.parametrize("k,num,den", [(5, 60, 100), (3, 90, 100), (1, 1, 3)])
def test_jaccard_counts_links_in_components(spark, rows, block, k, num, den, monkeypatch):
    monkeypatch.setattr(link_counts, "BLOCK", block)  # 3: components in many blocks
    monkeypatch.setattr(link_counts, "BIN", 4)
    odd = [*rows, (10, "its own words of another text", None, None, 0), (3, rows[6][1], None, None, 0), (3, rows[7][1], None, None, 0), (3, rows[7][1], None, None, 0), (None, rows[6][1], None, None, 0)]
    got = jaccard_join.counts(spark.createDataFrame(odd, SCHEMA), k, num, den).collect()
    want = Counter((r[0], n) for r, n in zip(odd, plain_links(odd, k, num, den)))
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == want
    again = jaccard_join.join(spark.createDataFrame(odd, SCHEMA), k, num, den).collect()
    assert Counter(tuple(r)[:3] for r in got) == Counter(map(tuple, again))


@pytest.mark.parametrize("block,heavy", [(512, 1024), (16, 1024), (16, 2)])
def test_linked_copies(spark, block, heavy, monkeypatch):
    monkeypatch.setattr(link_counts, "BLOCK", block)
    monkeypatch.setattr(link_counts, "HEAVY", heavy)
    rng, sets = random.Random(8), []
    for c in range(4):  # near copies, a chain, pairs far apart, and one set alone
        base = rng.sample(range(10**6), 60)
        for i in range([150, 60, 2, 1][c]):
            s = base[3 * i % 50 :] + rng.sample(range(10**6), 3 * i % 50 + i) if c == 1 else base[rng.randrange(4) :] + rng.sample(range(10**6), rng.randrange(4))
            sets.append((c, len(sets), c, len(set(s)), rng.randint(1, 3), rng.randint(0, 5), sorted(set(s))))
    members = spark.createDataFrame([*sets, sets[0]], "comp long, k1 long, k2 long, n int, copies long, degree long, s array<long>")
    for num, den in ((90, 100), (80, 100)):
        got = {r["k1"]: r["others"] for r in link_counts.linked_copies(members, num, den).collect()}
        links = lambda x, y: den * len({*x} & {*y}) >= num * len({*x} | {*y})
        assert got == {a[1]: sum(b[4] for b in sets if b[0] == a[0] and b[1] != a[1] and links(a[6], b[6])) for a in sets}
    assert link_counts.linked_copies(members.limit(0), 90, 100).count() == 0


def test_keep_one_judges_rows(spark):
    a, b, c = ("a b c d e f g", "t u v w x y z", "h i j k l m n")
    odd = spark.createDataFrame([(1, a, "x", None, 0), (1, b, "x", None, 0), (1, a, "z", None, 0), (2, b, "x", None, 0), (3, c, "x", None, 0), (3, None, "x", None, 0), (None, a, "x", None, 0), (None, a, "x", None, 0)], SCHEMA)
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (3, c), (3, None), (None, a), (None, a)], key=str)


def test_boundary_follows_cost():
    rule = jaccard_join.Rule(3, 90, 100)
    assert rule.need(10, 10) == 10 and rule.prefix(10) == 2
    assert 0 < rule.boundary({s: 100 for s in range(1, 80)}) < 40


# --- 2 --------------------------------------------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>one<p>two", "one\n\ntwo"), ("a<br>b", "a\nb"), ("<b>a</b><i>b</i> c", "ab c"),
    ("<ul><li>a<li>b<ol><li>c<li>d</ol></ul>", "- a\n- b\n  1. c\n  2. d"), ("<ol start=3><li>x</ol>", "3. x"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1</table>", "Name   N\nalpha  1"), ("<head><title>t</title></head><body>b", "b"),
    ('<div hidden>x</div><div style="display:none"><p>y</p></div>z', "z"), ('<a title="hidden style=\'display:none\'">shown</a>', "shown"),
    ('<script>var t="</p>";</script><style>p{}</style><!-- c --><noscript>n</noscript>v', "v"), ("<pre>a\n  b</pre>", "a\n  b"), ("a < b > c", "a < b > c"),
    ("</div></p>x</table>", "x"), ("<td>loose</td>", "loose"), ("<h1>T</h1>text", "T\n\ntext"), ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a   b\n\nin"),
]


def test_html(spark):
    pages = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)}
    assert html_text.extract(pages.limit(0)).count() == 0
    assert html_text.render("<div>" * 50_000 + "deep") == "deep"


@pytest.mark.parametrize(
    "source,text",
    [
        ("<html><head><title>T</title><p>Hello</p></html>", "Hello"), ("<head><meta charset=utf-8><link href=x>Hello", "Hello"), ("<head><style>p{}</style>\n<img src=x><b>x</b>", "x"),
        ('<p>a <svg width="5"/> b</p>c', "a b\n\nc"), ("a<math/>b", "ab"), ("<svg><title/><path d='M0'/><text x=1>in</text></svg> out", "in out"), ("<svg width=5/><text>t</text></svg>u", "t u"), ("<svg>none<p>para", "para"),
        ('<div aria-hidden="false">a</div>', "a"), ('<p aria-hidden="true">b', "b"), ('<p data-hidden="1">c', "c"), ('<p style="overflow:hidden !important">d', "d"), ("<p style='hidden'>e", "e"), ("<p title='a hidden b'>f", "f"),
        ("<p HIDDEN>x</p>y", "y"), ('<p hidden="">x</p>y', "y"), ("<p class=a style=display:none>x</p>y", "y"), ('<p style="color:red; Visibility : hidden !important">x</p>y', "y"), ("<dialog data-open>x</dialog>y", "y"), ("<dialog open>x</dialog>", "x"),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math>", "x=2"), ("<svg>no<desc>no</desc><defs><text>no</text></defs><text>a</text><text>b</text></svg>", "a b"),
        ("<xmp>a <b>\n &amp; c</xmp>d", "a <b>\n &amp; c\n\nd"), ("<map name=m>links <a href=x>here</a><area></map>", "links here"),
    ],
)
def test_html_shows_all_visible_text(source, text):
    assert html_text.render(source) == text


def test_html_keeps_every_word():
    rng = random.Random(2)
    tags = ["p", "div", "b", "li", "ul", "td", "tr", "table", "h2", "span", "section", "pre"]
    for _ in range(200):
        source = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", f" w{i} "]) for i in range(60))
        assert Counter(re.findall(r"w\d+", html_text.render(source))) == Counter(re.findall(r"w\d+", source))


# --- 3 --------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full) or 1
        got = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / share for s in order}
        over = {s for s in order if got[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not over:
            return got
        full |= over


def test_mixing(spark, docs, rows):
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["size"] for r in got} == {i: len(words(t)) for i, t, *_ in rows}
    sizes = defaultdict(int)
    for i, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    want, taken, largest = plain_targets(dict(sizes)), defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    again = mixing.plan(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["size"] and r["copies"]})


def test_mixing_is_fair_and_exact(spark):
    rows = [(i, "w " * (1 + i % 9), None, "a" if i % 3 else "b", 0) for i in range(3000)] + [(i, None, None, "c", 0) for i in (1, 1, 2)]
    got = mixing.plan(spark.createDataFrame(rows, SCHEMA)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert all(abs(r["t"] - r["target"]) <= 5 for r in got) and sum(r["n"] for r in got) == 3003


def test_mixing_edges(spark, none):
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0
    same = spark.createDataFrame([(1, "a b", None, "s", 0)] * 4 + [(None, "c", None, None, 0)], SCHEMA)
    assert mixing.plan(same).count() == 5
    assert mixing.mix(same).count() == sum(r["copies"] for r in mixing.plan(same).collect())


# --- 4 --------------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(docs, rows, none):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, path, P.PATTERN).collect()}
    for i, t, *_ in rows:
        ids = want.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(none, path, P.PATTERN).count() == 0
    rng, engine = random.Random(3), bpe.Engine(ranks, P.PATTERN)
    odd = ["".join(rng.choice("abc \n\t.,1é漢😀\x1c\x85") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["a" * 700, "ab" * 300 + "ba" * 200, "don't 'll  we\r\n x"]
    assert [ids.tolist() for ids, _ in engine.run(odd)] == [want.encode_ordinary(t) for t in odd]
    engine.rest()
    assert [d for _, d in engine.run(odd)] == [t.encode() for t in odd]


# --- 5 --------------------------------------------------------------------------------------------------------


def test_toxicity(spark, none):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    data = []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(rng.randint(2, 4)):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "moron", "scum"])
        data.append((i, " ".join(w), bad))
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t, _ in data] + [(5000, None, None, None, 0), (5001, "", None, None, 0)], SCHEMA)
    labels = spark.createDataFrame([(i, 0, int(b)) for i, _, b in data] + [(0, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(b, got[i]["predicted"]) for i, _, b in data if i % 3 == 0]
    assert sum(int(b) == p for b, p in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 1202 and got[5000]["predicted"] == 0
    kept = toxicity.keep_clean(docs, labels, F.lit(True))
    assert kept.columns == docs.columns and 5000 in {r["doc_id"] for r in kept.collect()} and kept.count() < 1202
    one = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, one).collect()} == {0.0}
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0), F.lit(True))).count() == 0


def test_toxicity_learns_one_text_of_each_id(spark, monkeypatch):
    seen, boost = [], toxicity.boost
    monkeypatch.setattr(toxicity, "boost", lambda x, y: seen.append(len(y)) or boost(x, y))
    rows = [(i, "you scum" if i % 2 else "fine words", None, None, 0) for i in range(40)] + [(1, f"text {j}", None, None, 0) for j in range(200)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    toxicity.fit(spark.createDataFrame(rows, SCHEMA), labels, F.lit(True))
    assert seen[0] <= 40


def test_isotonic_is_monotone():
    x, y = np.arange(50.0), (np.random.default_rng(0).random(50) < np.linspace(0, 1, 50)).astype(float)
    knots, values = toxicity.isotonic(x, y)
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()


# --- 6 --------------------------------------------------------------------------------------------------------


def test_langid(spark, docs, none):
    en = ["the cat and the dog", "this is what they said", "where have you been", "nothing of the kind"] * 5
    de = ["der hund und die katze", "das ist nicht wahr", "wo bist du gewesen", "nichts von der art"] * 5
    rows = [(i, t, "en", None, 0) for i, t in enumerate(en)] + [(100 + i, t, "de", None, 0) for i, t in enumerate(de)] + [(200, None, "en", None, 0), (201, "123 !?", "de", None, 0), (202, "the and that", None, None, 0), (203, "nicht und das", None, None, 0), (None, "the", "zz", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in langid.identify(df, F.col("doc_id") < 200, F.col("doc_id") >= 200).collect()}
    assert got[202]["lang_pred"] == "en" and got[203]["lang_pred"] == "de" and got[200]["lang_pred"] == got[201]["lang_pred"] == "und" and got[200]["score"] == 0
    assert got[200]["held_out"] and not got[None]["held_out"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none, F.lit(True), F.lit(False)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, F.lit(False), F.lit(False)).collect()} == {"und"}


def test_langid_batch_equals_single():
    texts = ["der hund", "a", "the cat\nsat", "é"]
    matrix = np.log(np.random.default_rng(1).random((1 << langid.BITS, 3)) + 0.1).astype(np.float32)
    names, scores = langid.score_batch(texts, ["a", "b", "c"], matrix)
    for t, name, s in zip(texts, names, scores):
        one = langid.score_batch([t], ["a", "b", "c"], matrix)
        assert one[0] == [name] and one[1][0] == pytest.approx(s)


def test_langid_bounds_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdeé ") for _ in range(rng.choice([1, 2, 30, 400]))), f"l{i % 7}", None, 0) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = langid.fit(df, F.lit(True))
    texts = [t for _, t, *_ in rows]
    names, scores = langid.score_batch(texts, *wide)
    monkeypatch.setattr(langid, "STEP", 35)
    again, close = langid.score_batch(texts, *wide)
    assert names == again and scores == pytest.approx(close)
    whole = langid.count_grams(df.coalesce(1), F.lit(True)).collect()
    monkeypatch.setattr(langid, "HELD", 2)
    held = langid.count_grams(df.coalesce(1), F.lit(True)).collect()
    assert sorted(map(tuple, held)) == sorted(map(tuple, whole))


# --- 7 --------------------------------------------------------------------------------------------------------


def test_line_dedup(docs, rows, none, spark):
    strip, holders = " \t\n\x0b\f\r", defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            key = line.strip(strip).translate(LOWER)
            if len(key) >= 40:
                holders[key].add(i)
    want = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(h := holders.get(x.strip(strip).translate(LOWER), ())) < 5 or max(h) == i]
        want[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.digest(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0
    assert line_dedup.digest(none).count() == 0
    clean = line_dedup.clean(docs)
    assert clean.columns == docs.columns and clean.where("doc_id = 0").first()["text"] is None
    nameless = spark.createDataFrame([(None, "y" * 50, None, None, 0)] * 3 + [(i, "Y" * 50, None, None, 0) for i in (1, 2)], SCHEMA)
    assert sorted(r["n_dropped"] for r in line_dedup.digest(nameless).collect()) == [0, 1, 1, 1, 1]


# --- 8 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [3, 1024])
def test_exact_dedup(docs, rows, none, spark, block, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", block)
    few = [r for r in rows if len(r[1] or "") < 3500]
    groups = defaultdict(list)
    for i, t, *_ in few:
        groups[re.sub(common.WS, " ", t or "")].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.groups(docs.where("coalesce(length(text), 0) < 3500")).collect()}
    assert got == want and max(w[1] for w in want.values()) > 5
    assert exact_dedup.groups(none).count() == 0
    odd = spark.createDataFrame([(None, "a", None, None, 0), (3, "a", None, None, 0), (3, "a", None, None, 0), (3, "b", None, None, 0), (None, None, None, None, 0)], SCHEMA)
    got = sorted((tuple(r)[:4] for r in exact_dedup.groups(odd).collect()), key=str)
    assert got == [(3, 3, 1, True), (3, 3, 2, True), (None, 3, 2, False), (None, None, 1, True)]


def test_exact_dedup_query_returns_every_row(spark, tmp_path):
    import duckdb

    long = "long text " * 500
    odd = [(None, "a", None, None, 0), (3, "a", None, None, 0), (3, "a", None, None, 0), (3, "b", None, None, 0), (None, None, None, None, 0), (None, "", None, None, 0), (4, long, None, None, 0), (4, long, None, None, 0), (5, long, None, None, 0)]
    spark.createDataFrame(odd, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = exact_dedup.query(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(exact_dedup.ORACLE).fetchall()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == sorted(((a, b, c, e) for a, b, c, _, e in want), key=str)
    assert len(got) == len(odd)


# --- 9 --------------------------------------------------------------------------------------------------------


def test_ann(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 300)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[50:80] = x[0]  # ties
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)]
    bad = [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] * 16, 0), (5003, [1.0, None] * 8, 0), (5004, [1.0] * 3, 0), (None, [1.0] * 16, 0), (5100, [], 0)]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y, hit = x.astype(np.float64), 0
    assert set(got) == set(range(0, 900, 50))
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        truth = sorted((d[i], i) for i in range(900) if i != q)[:10]
        hit += len({i for _, i in truth} & {i for i, _ in found})
        assert found == sorted(found, key=lambda p: (p[1], p[0])) and all(s == pytest.approx(d[i]) for i, s in found) and len(found) == 10
    assert hit >= 0.9 * 10 * len(got) and [i for i, _ in got[0]] == list(range(50, 60))
    few = ann.search(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>, label int"), F.col("vec_id") == 0)
    assert few.count() == 3
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), F.lit(True)).count() == 0


def test_ann_climbs_to_enough_neighbours(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((44, 16)), 10, axis=0)  # groups of ten equal vectors fill the entries at full depth
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 10 == 0).collect()
    assert Counter(r["query_id"] for r in got) == {i: 10 for i in range(0, 440, 10)}
    for q in range(0, 440, 10):
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q][:9] == list(range(q + 1, q + 10))


def test_ann_sends_the_driver_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 200)
    rng = np.random.default_rng(5)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(rng.standard_normal((6400, 64)) + 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(32, "vec_id")
    conf = spark.sparkContext._jsc.sc().conf()
    was = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "1m")  # the sample has 0.1 MB, but 32 tasks' candidates for it have 3
    try:
        got = ann.search(vectors, F.col("vec_id") % 800 == 0).collect()
    finally:
        conf.set("spark.driver.maxResultSize", was)
    assert Counter(r["query_id"] for r in got) == {i: 10 for i in range(0, 6400, 800)}


def test_ann_middle(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 50)
    x = np.random.default_rng(6).standard_normal((2000, 4)) + 3
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, v array<double>")
    mean = ann.middle(rows, 2000)
    assert np.abs(mean - 3).max() < 0.8 and (mean == ann.middle(rows.repartition(7), 2000)).all()
    copies = spark.range(2000).selectExpr("7L AS vec_id", "array(1.0D, 2.0D) AS v")
    assert ann.middle(copies, 2000).tolist() == [1, 2]
    assert np.allclose(ann.middle(rows.limit(30), 30), x[:30].mean(0))


def test_ann_shuffle_and_recall_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 100)  # 200 shards before; each gets every query
    x = np.random.default_rng(7).standard_normal((20_000, 16)).astype(np.float32)
    vectors = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.length()))

    was = written()
    got = defaultdict(list)
    for r in ann.search(vectors, F.col("vec_id") % 10 == 0).collect():
        got[r["query_id"]].append(r["vec_id"])
    assert written() - was < 40e6
    y, hit = x.astype(np.float64), 0
    for q in range(0, 20_000, 200):
        d = ((y - y[q]) ** 2).sum(1)
        hit += len(set(np.argsort(d, kind="stable")[1:11]) & set(got[q]))
    assert len(got) == 2000 and hit >= 0.9 * 1000


def test_ann_repeated_ids_and_huge_vectors(spark):
    x = np.random.default_rng(8).standard_normal((600, 16)).astype(np.float32)
    x[300:340] = x[0] + 1e-3 * x[300:340]  # rows of the query's own id
    x[590:] *= np.float32(1e30)
    rows = [(0 if 300 <= i < 340 else i, [float(a) for a in v]) for i, v in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id").isin(0, 10, 599)).collect()
    y = x.astype(np.float64)
    first = min((list(map(float, x[i])), i) for i in [0, *range(300, 340)])[1]
    for q, at in ((0, first), (10, 10), (599, 599)):
        d = sorted((((y[i] - y[at]) ** 2).sum() ** 0.5, r[0]) for i, r in enumerate(rows) if r[0] != q)[:10]
        found = sorted((r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert len(found) == 10
        assert sum((Counter(i for _, i in d) & Counter(i for _, i in found)).values()) >= 8


# --- 10 -------------------------------------------------------------------------------------------------------


def test_lm(spark, docs, rows, none, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 40)
    fold = common.bucket_of(F.col("doc_id"), 7)
    got = {r["doc_id"]: r for r in lm.score(docs, fold != 2, fold == 2).collect()}
    tokens = {i: [*words(t), None] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) and r["score"] < 0
    assert lm.score(none, F.lit(True), F.lit(False)).count() == 0
    alone = lm.score(docs, F.lit(False), F.lit(True)).where("doc_id = 3").first()
    assert alone["train_tokens"] == 0 and alone["base_score"] == alone["score"] == 0.0


def test_lm_learns(spark):
    rng = random.Random(6)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(100)), None, None, 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    r = lm.score(df, F.col("doc_id") < 300, F.col("doc_id") >= 300).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0] * 0.9  # half the words at most in either kind: 0.83 at best


@pytest.mark.parametrize("bits", [0, 3])
def test_lm_sums_to_one(bits):
    rng = np.random.default_rng(0)
    types = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64) << np.uint64(1))
    model = lm.factor(types, rng.integers(1, 1000, 300), rng.integers(0, 5, 300), bits, rng.random(1 << bits) * 50 + 1)
    leaves = np.concatenate([model.leaf, model.bucket_leaf])
    assert sorted(leaves) == list(range(300 + (1 << bits)))
    ctx = np.repeat(lm.contexts(np.array([3], np.uint64), np.array([1])), len(leaves), axis=1)
    for weights in (np.zeros(1 << 10, np.float32), rng.standard_normal(1 << 12).astype(np.float32)):
        total = 10 ** model.walk(weights, ctx, leaves)
        assert total.sum() == pytest.approx(1, abs=1e-4)
        if not weights.any():  # without weights, the unigram shares
            mass = np.concatenate([model.counts + 1.0, 10**model.bucket_mass])
            assert total == pytest.approx(mass / mass.sum(), rel=1e-3)
    # Halvings between classes come first on every way.
    within = np.zeros(len(leaves), bool)
    node = np.full(len(leaves), model.root)
    while (live := node >= 0).any():
        assert not (within & live & (node < lm._WITHIN)).any()
        within |= live & (node >= lm._WITHIN)
        at = np.where(live, node & ~lm._WITHIN, 0)
        node = np.where(live, model.after[2 * at + (leaves >= at)], -1)


def test_lm_walks_by_legs():
    rng = np.random.default_rng(4)
    mass, cls = rng.zipf(1.3, 500).clip(max=10**6).astype(float), np.sort(rng.integers(0, 20, 500))
    after, bias, root = lm.halvings(mass, cls)
    ways = lm.ways(after, bias, root, mass)
    for leaf in range(500):
        for within in (False, True):  # the legs pass the halvings between classes, then those within one, in order
            for leg in ways.legs[within][ways.first[within][leaf] : ways.first[within][leaf + 1]]:
                for step, side in zip(lm._STEP[:, leg & 31], lm._SIDE[:, leg & 31]):
                    if side:
                        node = root & ~lm._WITHIN if root >= 0 else 0
                        assert (root >= lm._WITHIN) == within and side == (1 if leaf >= node else -1)
                        assert ways.bias[(leg >> 5) * 16 + step] == bias[node]
                        root = after[2 * node + (side > 0)]
        assert root == -1
        root = lm.halvings(mass, cls)[2]


def test_lm_training_stays_in_the_cache(monkeypatch):
    rng = np.random.default_rng(5)
    types = np.sort(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) << np.uint64(1))
    model = lm.factor(types, rng.zipf(1.3, 5000).clip(max=10**6), rng.integers(0, 16, 5000), 0, np.ones(1))
    h, n = rng.choice(types, 5000), np.array([5000])
    size, spans, touched, add = 1 << 20, [], np.zeros(1 << 20, np.complex64), np.add

    class Watched:
        def __getattr__(self, name):
            return getattr(add, name)

        def at(self, to, rows, values):
            spans.append(int(rows.max()) - int(rows.min()))
            add.at(to, rows, values)

    monkeypatch.setattr(np, "add", Watched())
    model.walk(np.zeros(size, np.float32), lm.contexts(h, n), model.leaves(h)[1], touched)
    # One call adds to an eighth of the table at most, and all of the table is in use.
    assert spans and max(spans) < size // 8
    assert all(part.any() for part in np.split(touched, 16))


def test_lm_long_texts_go_by_stretches(monkeypatch):
    rng = np.random.default_rng(6)
    types = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64) << np.uint64(1))
    model = lm.factor(types, rng.integers(1, 1000, 300), rng.integers(0, 5, 300), 2, rng.random(4) * 50 + 1)
    h, n, weights = rng.choice(types, 1000), np.array([700, 300]), rng.standard_normal(1 << 12).astype(np.float32)
    ctx, leaf, whole, parts = lm.contexts(h, n), model.leaves(h)[1], np.zeros(1 << 12, np.complex64), np.zeros(1 << 12, np.complex64)
    scores = model.walk(weights, ctx, leaf)
    model.walk(weights, ctx, leaf, whole)
    monkeypatch.setattr(lm, "STRETCH", 128)
    assert model.walk(weights, ctx, leaf) == pytest.approx(scores, abs=1e-5)
    model.walk(weights, ctx, leaf, parts)
    assert np.allclose(parts, whole, atol=1e-3)


def test_lm_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    types = np.sort(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    model = lm.factor(types, rng.integers(1, 100, 40), rng.integers(0, 4, 40), 0, np.ones(1))
    h, n = rng.choice(types, 200), np.array([120, 80])
    ctx, leaf, weights = lm.contexts(h, n), model.leaves(h)[1], (rng.standard_normal(1 << 10) / 4).astype(np.float32)
    sums, log = np.zeros(len(weights), np.complex64), lambda w: model.walk(w, ctx, leaf).sum() * math.log(10)
    model.walk(weights, ctx, leaf, sums)
    for i in np.argsort(-sums.imag)[:5]:
        up = weights.copy()
        up[i] += 0.05
        down = weights.copy()
        down[i] -= 0.05
        assert (log(up) - log(down)) / 0.1 == pytest.approx(sums.real[i], abs=0.02)


def test_lm_classes_follow_company():
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.normal(1, 0.2, (50, 16)), rng.normal(-1, 0.2, (50, 16))])
    cls = lm.bisect(vectors, np.full(100, 20.0), 1)
    assert len(set(cls[:50])) == len(set(cls[50:])) == 1 and cls[0] != cls[-1]
    assert set(lm.bisect(np.zeros((7, 16)), np.ones(7), 3)) == {0}


def test_lm_places():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 1000):
        table = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) << np.uint64(1))
        asked = np.concatenate([table, rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        at = lm.places(table, lm.starts(table), asked)
        assert at.tolist() == [int(np.searchsorted(table, x)) if x in table else -1 for x in asked]


def test_lm_trains_on_every_token(spark):
    text = " ".join(f"w{i}" for i in range(15))  # with its end, 16 tokens
    docs = spark.createDataFrame([(i, text, None, None, 0) for i in range(64)], SCHEMA)
    h, n = lm.tokens([text])
    types = np.sort(h)
    model = lm.factor(types, np.full(16, 64), np.zeros(16, np.int64), 0, np.ones(1))
    ctx, leaf = lm.contexts(h, n), model.leaves(h)[1]
    weights = lm._train(docs, model, 64 * 16)
    assert (model.walk(weights, ctx, leaf) > model.walk(weights * 0, ctx, leaf) + 0.01).all()
    one = lm._summed(docs.select("text").repartition(5), 64 * 16, 64, lambda texts, total: np.add.at(total, model.leaves(lm.tokens(texts)[0])[1], np.float32(1)))
    assert one[:17].tolist() == [64.0 * (i in set(leaf)) for i in range(17)]
