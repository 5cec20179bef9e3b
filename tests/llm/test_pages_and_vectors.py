from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailtally.llm import embedding_dedup, html_extract, url_filter
from trailtally.llm.components import components
from trailtally.llm.hnsw import Graph


def text_of(page):
    return html_extract.main_text(page, html_extract.PRIOR)


# url filters


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    (None, "", "", None, "allow"),
    ("no scheme/x", "", "", None, "allow"),
    ("http://A.Example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/EN/1", "example.net", "/EN/1", "net/", "block"),
    ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://example.net", "example.net", "", None, "allow"),
    ("http://x.example.com/de/?q=://y#z", "x.example.com", "/de/", "example.com/de/", "block"),
    ("http://a.org/fr/x#y", "a.org", "/fr/x", "org/fr/", "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://É.com?x", "É.com", "", None, "allow"),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    outcomes = spark.createDataFrame([], "host string, bad boolean")
    row = url_filter.judge_urls(pages, outcomes).first()
    assert tuple(row) == (1, host, path, rule, verdict)


def test_reputation_blocks_bad_hosts_and_shrinks_small_ones(spark):
    rows = [("bad.x.com", True)] * 40 + [("new.x.com", True)] + [("good.y.com", False)] * 60 + [("good.z.com", False)] * 60
    outcomes = spark.createDataFrame(rows + [(None, True), ("q.com", None)], "host string, bad boolean")
    found = {row["host"]: row for row in url_filter.host_reputation(outcomes).collect()}
    assert set(found) == {"bad.x.com", "new.x.com", "good.y.com", "good.z.com"}
    assert found["bad.x.com"]["bad_low"] > 0.5
    assert found["good.y.com"]["bad_mean"] < 0.1
    # One bad page is not enough by itself, but its domain is bad.
    assert 0.5 < found["new.x.com"]["bad_mean"] < found["bad.x.com"]["bad_mean"]
    pages = spark.createDataFrame([(1, "http://bad.x.com/1"), (2, "http://good.y.com/2")], "page_id long, url string")
    judged = {row["page_id"]: row["verdict"] for row in url_filter.judge_urls(pages, outcomes).collect()}
    assert judged == {1: "block", 2: "allow"}


def test_hosts_without_outcomes_take_their_domain_or_suffix(spark):
    rows = [(f"h{k}.bad.com", True) for k in range(30) for _ in range(20)]
    rows += [(f"h{k}.good{k}.com", False) for k in range(40) for _ in range(20)]
    rows += [(f"h.{k}.zz", True) for k in range(30) for _ in range(20)]
    outcomes = spark.createDataFrame(rows, "host string, bad boolean")
    urls = ["http://new.bad.com/", "http://bad.com/x", "http://new.good1.com/", "http://other.com/", "http://a.new.zz/", "http://a.b.unknown/", "/none"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    judged = {row["page_id"]: row["verdict"] for row in url_filter.judge_urls(pages, outcomes, rules=()).collect()}
    assert judged == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow", 6: "allow"}
    none = url_filter.judge_urls(pages, outcomes.limit(0), rules=()).collect()
    assert {row["verdict"] for row in none} == {"allow"} and len(none) == len(urls)


def test_registered_domains(spark):
    hosts = ["a.b.co.uk", "b.com", "x.y.b.com", "localhost", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = url_filter.registered_domain(F.col("host"))
    assert [tuple(r) for r in df.select(domain, suffix).collect()] == [
        ("b.co.uk", "co.uk"), ("b.com", "com"), ("b.com", "com"), ("localhost", "localhost"), ("", "")
    ]


# html extraction

ARTICLE = "<article><h1>Head</h1><p>One &amp; two,\n three.<br>four <b>bo</b>ld<p>Ti.</p><ul><li>item</ul></article>"


def test_html_takes_the_article_only():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header><h2>Site</h2></header><nav><ul><li><a href='/x'>menu</a></li></ul></nav><!-- no <p>x</p> -->"
        f"<div class='ad'>Buy this, it is good.</div>{ARTICLE}<aside>Other stories</aside><form>Your name <input></form>"
        "<div class='cookie-notice'>We use cookies.</div><section id='comments'><article>Nice text, thank you.</article>"
        "</section><footer>&copy; x</footer>"
    )
    assert text_of(page) == "Head\n\nOne & two, three. four bold\n\nTi.\n\nitem"


def test_html_without_telling_markup():
    prose = "A long paragraph of plain text, with commas, and with more words than any menu would ever have."
    page = (
        "<html><body><div><a href=a>Home</a> <a href=b>About us</a> <a href=c>Contact</a></div>"
        f"<div><p>{prose}<p>{prose} It goes on.</div><div><a href=d>Imprint</a></div>"
    )
    assert text_of(page) == f"{prose}\n\n{prose} It goes on."


@pytest.mark.parametrize(("page", "expected"), [
    ("", ""), ("<p>", ""), ("<article><<<>>>", "<<<>>>"), ("<article>x &lt;b&gt; y", "x <b> y"),
    ("<article><p title='a>b'>x</p><p>y", "x\n\ny"), ("<article>a<script>x", "a"), ("<article>a <!-- b", "a"),
    ("<article>a<p hidden>b</p><p style='display: none'>c</p>", "a"), ("<article>1 < 2 &nbsp; &#65;", "1 < 2 A"),
    ("<article>a <b", "a"),
])
def test_html_odd_pages(page, expected):
    assert text_of(page) == expected


TEXT = "The town hall was built of brick, and it has stood on the hill since then."


@pytest.mark.parametrize("page", [
    "<body class='has-sidebar'><article>{}</article>", "<body class='sidebar login'><article>{}</article>",
    "<main class='content no-ads'><p>{}</main>", "<main class='sidebar'><p>{}</main>",
    "<form id=f><div id=content><p>{}</div></form>", "<form><p>{}</form>", "<div class='sidebar page'><div class=content>{}</div></div>",
    "<div id=x class='with-sidebar'><p>{}</div>", "<nav>a <article>{}</article></nav>",
    "<article class='post tag-login'>{}</article>", "<form><nav>a</nav><article>{}</article><footer>x</footer></form>",
])
def test_html_wrappers_do_not_hide_the_article(page):
    assert text_of(page.format(TEXT)) == TEXT


@pytest.mark.parametrize(("page", "expected"), [
    ("<article>a <math><mi>x</mi><mo>=</mo></math> b", "a x= b"), ("<article>a<object>b</object>", "a\n\nb"),
    ("<article>a<noscript>b</noscript>", "a\n\nb"), ("<article>a<xmp><b>&amp;</xmp>c", "a\n\n<b>&amp;\n\nc"),
    ("<article>a <svg><p>b<p>c", "a\n\nb\n\nc"), ("<article>a <select>b <math>c <object>d <noscript>e", "a b c\n\nd\n\ne"),
    ("<article>a<textarea>b", "a"), ("<article>a <svg><text>b</text></svg> c", "a c"),
])
def test_html_keeps_text_of_special_elements(page, expected):
    assert text_of(page) == expected


def test_html_parts_beside_the_article_stay_out():
    page = (
        f"<body><div class='sidebar'><p>{TEXT} {TEXT} {TEXT}</div><article>{TEXT}<div class='share'>Share it now.</div></article>"
        f"<div class='comments'><article>{TEXT} {TEXT} {TEXT}</article></div><footer><div class='content'>{TEXT}</div></footer>"
        f"<div hidden><article>{TEXT}</article></div>"
    )
    assert text_of(page) == TEXT


def test_html_fit_counts_every_block(spark):
    page = "<article>" + "<p>Short one.</p>" * 300 + "</article><nav>" + "<p>Some menu with many more words</p>" * 30 + "</nav>"
    found = html_extract.fit(spark.createDataFrame([(1, page)], "page_id long, html string"))
    blocks = html_extract.page_blocks(page)
    rows = np.round([html_extract.block_features(block) for block in blocks], 1)
    assert np.allclose(found, html_extract.fit_weights(rows, np.array(["here" in block.marks for block in blocks])))


def test_html_long_pages_end():
    page = "<article>" + "<div>" * 3000 + "<p>some text here.</p><nav><a>x</a></nav>" * 3000
    assert text_of(page).count("some text here.") == 3000


def test_min_cut_against_all_labellings():
    rng = np.random.default_rng(2)
    for _ in range(60):
        size = int(rng.integers(1, 8))
        costs = rng.normal(0, 1, size).tolist()
        edges = [(a, b, float(rng.random())) for a in range(size) for b in range(a) if rng.random() < 0.6]

        def total(labels):
            unary = sum(max(0, -c) if label else max(0, c) for c, label in zip(costs, labels))
            return unary + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(total([bool(k >> i & 1) for i in range(size)]) for k in range(1 << size))
        assert abs(total(html_extract.min_cut(costs, edges)) - best) < 1e-6


def test_min_cut_of_many_undecided_blocks():
    import time

    rng = np.random.default_rng(5)
    size = 20_000
    for scale in (0.2, 1.0, 3.0):
        costs = rng.normal(0, scale, size).tolist()
        edges = [(k - 1, k, 0.3) for k in range(1, size)] + [(k - 7, k, 0.4 / 7) for k in range(7, size)]
        start = time.perf_counter()
        labels = html_extract.min_cut(costs, edges)
        assert time.perf_counter() - start < 10
        # No single block or run between two borders is better the other way round.
        gain = [(-c if label else c) for c, label in zip(costs, labels)]
        for a, b, weight in edges:
            change = -weight if labels[a] != labels[b] else weight
            gain[a] -= change
            gain[b] -= change
        assert max(gain) <= 1e-6


def test_html_long_page_that_says_nothing():
    import time

    rng = np.random.default_rng(7)
    words = ["alpha", "beta", "gamma", "delta", "epsilon."]
    blocks = [f"<div>{' '.join(rng.choice(words, int(rng.integers(1, 12))))}</div>" for _ in range(20_000)]
    start = time.perf_counter()
    text = html_extract.main_text("<body>" + "".join(blocks) + "</body>", html_extract.PRIOR)
    assert time.perf_counter() - start < 10 and text


def test_html_query_takes_every_article(spark, data):
    import html
    import re

    rows = html_extract.page_texts(spark, data).collect()
    pages = {row["page_id"]: row["html"] for row in spark.read.parquet(f"{data}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for row in rows:
        article = re.search("<article>(.*?)</article>", pages[row["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article.replace("<br>", " ").replace("<b>", ""))
        texts = [" ".join(html.unescape(part).split()) for part in parts]
        assert row["text"] == "\n\n".join(text for text in texts if text)
        assert row["n_chars"] == len(row["text"])


# embeddings


def brute_links(rows, cosine=0.98):
    sound = []
    for k, (vec_id, vector, label) in enumerate(rows):
        if vec_id is None or label is None or vector is None or any(v is None for v in vector):
            continue
        x = np.array(np.array(vector, np.float32), float)
        if np.isfinite(x).all() and x.any():
            sound.append((k, vec_id, label, x / np.abs(x).max()))
    links = {k: set() for k in range(len(rows))}
    for i, (k, _, label, x) in enumerate(sound):
        for m, _, other, y in sound[:i]:
            if label == other and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[k].add(m)
                links[m].add(k)
    component = {k: rows[k][0] for k in links}
    changed = True
    while changed:
        changed = False
        for k, near in links.items():
            least = min([component[k], *(component[m] for m in near)]) if near else component[k]
            if least != component[k]:
                component[k], changed = least, True
    return sorted(((rows[k][0], len(links[k]), component[k]) for k in links), key=repr)


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        rows.append((k, rng.normal(0, 1, 16).tolist(), k % 3))
    for k in range(400, 700):
        # Near copies around a few vectors, close to the threshold, and some exact copies.
        base = np.array(rows[k % 12][1])
        noise = rng.normal(0, 1, 16) * np.linalg.norm(base) * rng.choice([0, 0.02, 0.04, 0.06]) / 4
        rows.append((k, (base + noise).tolist(), k % 3))
    rows += [
        (900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, rows[0][1], None),
        (905, [1.0, 0.0], 1), (906, [3.0, 0.0], 1), (907, [float("inf"), 0.0], 1), (908, [], 1),
        # One id on two vectors, each with neighbours of its own.
        (5, [1.0, 0.01], 1), (5, [0.0, 1.0], 1), (909, [0.01, 1.0], 1), (910, [0.0, 2.0], 1), (910, [0.0, 2.0], 1), (5, rows[0][1], 2),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for shard_rows in (8192, 60):
        found = embedding_dedup.link_embeddings(df, shard_rows=shard_rows).collect()
        assert sorted(((r[0], r[1], r[2]) for r in found), key=repr) == brute_links(rows)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_graph_finds_neighbours_from_any_start():
    rng = np.random.default_rng(6)
    vectors = embedding_dedup.unit_rows(rng.normal(0, 1, (600, 24))).astype(np.float32)
    graph = Graph(vectors)
    hits = 0
    for query in vectors[:100]:
        true = set(np.argsort(-(vectors @ query))[:5].tolist())
        found = [node for _, node in graph.search(query, graph.descend(query, 0), 64)[:5]]
        hits += len(true & set(found))
    assert hits >= 0.9 * 500


def test_components_of_chains_stars_and_repeats(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (201, None), (7, 3), (7, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {row["node"]: row["component"] for row in components(df, "a", "b").collect()}
    assert found == {k: 1 for k in range(1, 61)} | {k: 100 for k in range(100, 140)}
    empty = spark.createDataFrame([], "a long, b long")
    assert components(empty, "a", "b").collect() == []
