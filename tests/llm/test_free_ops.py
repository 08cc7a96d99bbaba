import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import bpe, html_extract, near_dedup, pii, rp_forest, suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "Hello world", "naïve café — 漢字 😀", "a" * 500, "  spaces   and\n\nlines\t", "it's they'll 123 4567 !!??", "\x85\xa0 odd ", "word " * 3000]


def test_bpe_is_what_tiktoken_does(spark, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(80)) for _ in range(40)]
    coded = bpe.decode(bpe.encode(docs(texts).withColumn("ids", F.lit("clash"))))
    for r in coded.collect():
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == own.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()
    d = bpe.digests(coded).filter("doc_id = 3").first()
    assert d["ids_sha256"] == hashlib.sha256(" ".join(map(str, own.encode_ordinary(texts[3]))).encode()).hexdigest()
    assert bpe.encode(docs([]).limit(0)).count() == 0


def test_bpe_cache_may_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    codec = bpe.Codec(bpe.default_vocabulary(), bpe.default_pattern())
    first = codec.encode(["one two three four five", "six seven"])
    assert codec.encode(["one two three four five", "six seven"]) == first


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


ARTICLE = "<article><h1>Title &amp; more</h1><p>First   paragraph, with <b>bold</b> and\n<a href='x'>link</a>.<p>Second one; it ends&nbsp;here.<ul><li>item one, yes.<li>item two, no.</ul></article>"
WANT = "Title & more\n\nFirst paragraph, with bold and link.\n\nSecond one; it ends here.\n\nitem one, yes.\n\nitem two, no."


@pytest.mark.parametrize(
    "body",
    [
        ARTICLE,
        "<nav><ul><li><a>Home</a><li><a>News</a></ul></nav><div class='ad'>Buy this, now.</div>" + ARTICLE + "<footer>&copy; site, all rights.</footer>",
        "<header><h2>Site</h2></header><aside>Side, text.</aside>" + ARTICLE + "<section id='comments'><p>Nice, post.</p></section><form><label>Mail</label></form>",
        "<!-- ad <p>x</p> -->" + ARTICLE + "<div class='cookie-notice'>We use cookies, ok.</div><noscript>enable</noscript>",
        ARTICLE + "<div class='related-posts'><p>More, here.</p></div><script>unclosed <p>x",
    ],
)
def test_html(body):
    assert html_extract.extract(page(body)) == WANT


def test_html_keeps_what_stands_beside_a_long_block():
    long = "A long paragraph, of many words. " * 60
    body = f"<article><h1>The title, here</h1><p>A lead, short.</p><p>{long}</p><p>One more, short.</p></article>"
    assert html_extract.extract(page(body)) == f"The title, here\n\nA lead, short.\n\n{long.strip()}\n\nOne more, short."
    split = f"<main><section><p>{long}</p><p>{long}</p></section><section><p>A closing section, short.</p></section></main>"
    assert html_extract.extract(page(split)) == f"{long.strip()}\n\n{long.strip()}\n\nA closing section, short."


def test_html_edges(spark):
    assert [html_extract.extract(x) for x in (None, "", "<p>", "plain, text < 3 & so", "<p>a<!-- open", "<b>only, bold</b>")] == ["", "", "", "plain, text < 3 & so", "a", "only, bold"]
    deep = "<div>" * 3000 + "deep, text." + "</div>" * 3000
    assert html_extract.extract(deep) == "deep, text."
    df = spark.createDataFrame([(1, page(ARTICLE), "clash"), (2, None, "x")], "page_id long, html string, main_text string")
    got = {r["page_id"]: r["main_text"] for r in html_extract.extract_text(df).collect()}
    assert got == {1: WANT, 2: ""} and html_extract.extract_text(df.limit(0)).count() == 0


def shingle_set(text):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


def corpus(seed, n_base=12, copies=30):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    texts = []
    for b in range(n_base):
        base = [word() for _ in range(rng.randint(80, 200))] + (passage if b % 2 else [])
        for _ in range(copies if b == 0 else rng.randint(1, 6)):
            new = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
    return texts + [None, "", "  ", "one two", "One TWO", "one  two\n", "one two three four five", "ÀÉ one", "àé one"]


def test_near_duplicates(spark, docs):
    texts = corpus(2, copies=60)
    sets, want = brute_components(texts)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs(texts)).collect()}
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i), i


def test_near_duplicates_in_large_nodes(spark, docs, monkeypatch):
    """With tiny nodes every group has to branch, to be starred and then completed."""
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    texts = corpus(7, n_base=4, copies=40)
    _, want = brute_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_edges(spark, docs):
    assert near_dedup.near_duplicates(docs([]).limit(0)).count() == 0
    rows = near_dedup.near_duplicates(docs([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (-1, 5, False), (5, 5, True), (5, 5, True)]


def brute_repeats(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + n] for t in data for i in range(len(t) - n + 1))
    out = []
    for t in data:
        mask = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                mask[i : i + n] = True
        out.append((bytes(np.frombuffer(t, np.uint8)[~mask]), int(np.diff(np.concatenate([[0], mask.astype(int)])).clip(0).sum())))
    return out


@pytest.mark.parametrize("limit", [8192, 1])
def test_repeated_spans(spark, docs, limit):
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("ab é.") for _ in range(n))
    shared = [some(60), some(45), some(41)]
    texts = [some(rng.randint(0, 60)) + rng.choice(shared) + some(rng.randint(0, 60)) for _ in range(40)]
    texts += [None, "", "x" * 39, "x" * 100, "ab" * 60, shared[0], shared[0], shared[0][:50] + shared[1][5:], some(200)]
    want = brute_repeats(texts, 40)
    df = docs(texts)
    got = {(r["k1"], r["k2"]): r for r in suffix_dedup.repeated_spans(df, length=40, gram=20, bucket_limit=limit).collect()}
    text = F.coalesce("text", F.lit(""))
    for r in df.select("doc_id", F.xxhash64(text).alias("a"), F.xxhash64(F.lit(5), text).alias("b")).collect():
        found = got.get((r["a"], r["b"]))
        kept, spans = (bytes(found["kept"]), len(found["spans"])) if found else ((texts[r["doc_id"]] or "").encode(), 0)
        assert (kept, spans) == want[r["doc_id"]], r["doc_id"]


def test_repeated_spans_of_nothing(spark, docs):
    assert suffix_dedup.repeated_spans(docs([]).limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 8)).round(1)
    vectors[100:180] = vectors[7]  # one very common vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [0.0] * 8), (1020, [float("nan")] * 8), (1040, [1.0, None] + [0.0] * 6), (1060, [1.0, 2.0]), (1080, [float("inf")] * 8), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in rp_forest.neighbours(df, search_share=1.0, sample_rows=200, leaf_rows=10, block_rows=16, trees=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    scores = vectors @ vectors.T
    assert set(got) == set(range(0, 400, 20))
    for q, found in got.items():
        near = sorted((-scores[q, i], i) for i in range(400) if i != q)[:20]
        assert [round(s, 9) for _, s in found] == [round(-s, 9) for s, _ in near]
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (20, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rp_forest.neighbours(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 1.0), (20, 1, 0, 2.0), (20, 2, 1, 2.0)]
    assert rp_forest.neighbours(df.limit(0)).count() == 0


def test_personal_data(spark, docs):
    phone, card = "+49 (151) 555-12345", "4111 1111 1111 1111"
    texts = [
        f"Mail me: jo.doe@example.co.uk, or call {phone}. Later again 49 151 55512345 as said.",
        f"From 10.0.0.255 and 10.0.0.256, card {card} not 4111 1111 1111 1112.",
        None, "", "nothing here, 12 apples", "😀 a@b.de", "1" * 6000 + ".2.3.4", "+1 23",
    ]
    weights = pii.fit([t for t in texts if t])
    rows = {r["doc_id"]: r["spans"] for r in pii.find(docs(texts), weights).collect()}
    base = {i: [(s["kind"], texts[i][s["start"] : s["stop"]]) for s in rows[i] if s["base"]] for i in rows}
    assert base[0] == [("email", "jo.doe@example.co.uk"), ("phone", phone)]
    assert base[1] == [("ip", "10.0.0.255"), ("card", card)]
    assert base[5] == [("email", "a@b.de")] and not any(rows[i] for i in (2, 3, 4, 6, 7))
    assert [(s["kind"], texts[0][s["start"] : s["stop"]]) for s in rows[0] if not s["base"]] == [("phone", "49 151 55512345")]
    assert pii.find(docs([]).limit(0), weights).count() == 0


def test_belief_propagation_is_exact_on_a_tree():
    rng = np.random.default_rng(0)
    unary, tables = rng.normal(size=(3, 2)), rng.normal(size=(2, 2, 2))
    edges = np.array([[0, 1], [1, 2]])
    joint = np.exp(unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + tables[0][:, :, None] + tables[1][None])
    joint /= joint.sum()
    want = np.array([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))])
    assert np.allclose(pii.marginals(unary, edges, tables), want, atol=1e-4)


def test_components(spark):
    from lumenframe.llm.links import components

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 260)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(500, i) for i in range(501, 560)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_raise_where_they_have_not_settled(spark, monkeypatch):
    from lumenframe.llm import links

    path = spark.range(40).selectExpr("id a", "id + 1 b")
    monkeypatch.setattr(links, "MAX_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="settled"):
        links.components(path)


def test_base_spans_equal_the_patterns():
    """All four kinds against plain searches by the contract's patterns."""
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def plain(text):
        out = [(0, *m.span()) for m in email.finditer(text)]
        out += [(1, *m.span()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        out += [(2, *m.span()) for m in card.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        return out + [(3, *m.span()) for m in phone.finditer(text) if 9 <= len(digits(m)) <= 15]

    rng = random.Random(4)
    texts = ["".join(rng.choice("a1.@-+ %é(4)0") for _ in range(rng.randint(0, 60))) for _ in range(20000)]
    texts += ["a@b.c%d@e.f", "a@b.cd@e.fg", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111 +49 (30) 123456", "x@y", "@a.b"]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t


def test_base_spans_of_long_runs():
    import time

    began = time.perf_counter()
    assert pii.base_spans("a" * 500_000 + " x@y.de") == [(0, 500_001, 500_007)]
    assert pii.base_spans("1" * 300_000 + " 1.2.3.4")[0] == (1, 300_001, 300_008)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("opening", ["<div class='content has-sidebar'>", "<div class='search-result-article'>", "<div class='section-social-affairs'>", "<form action='/'><main>"])
def test_html_containers_of_an_article_stay(opening):
    prose = ["The first paragraph of the article tells, at some length, what happened.", "The second one, a little longer than the first, says why it did, and to whom."]
    page = f"<html><body><nav><a href='/'>Home</a></nav>{opening}<div class='entry-header'><h1>A title, and more</h1></div><p>{prose[0]}</p><p>{prose[1]}</p>"
    page += "<div class='cookie-bar'>We use cookies, as you know.</div><div class='post-comments'>Nice article, thank you.</div></body></html>"
    assert html_extract.extract(page) == "\n\n".join(["A title, and more", *prose])
