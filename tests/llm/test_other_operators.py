"""Pages, urls and embeddings."""

import collections
import glob
import os

import duckdb
import numpy as np
import pytest
from tidelog.llm import embedding_dedup, html_text, queries, url_filter

DATA = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="notice">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<main><article><header><h1>Title &amp; more&hellip;</h1></header><p>One<br>two&nbsp;three
 four <b>bold</b><p class=lead>Caf&eacute; &#8212; &#x41;</p><div class='share box'>Share this</div><form><input value="x">Mail <button>Go</button></form>
<ul><li>first<li>second</ul><table><tr><td>c1<td>c2</table><aside>aside</aside><p hidden>hidden</p><p style="display: none">gone</p><div id="ad-1"><p>Buy</p></div>
<section class="comments"><article><p>reader says</p></article></section><p>Last</p></article></main><div class="sidebar">side</div><footer>&copy; x</footer></body></html>"""


def test_page_structure():
    assert html_text.host_texts([PAGE]) == ["\n\n".join(["Title & more…", "One two three four bold", "Café — A", "first", "second", "c1", "c2", "Last"])]
    for broken in ("", "<", "<p", "plain text", "<p>a<p>b", "<article><p>open <b>and cut &am", "<script>never closed", "</p></div><p>x</p>", "<p title=\"quote>y</p>"):
        html_text.host_texts([broken])
    assert html_text.host_texts(["<article><p>open <b>and cut &am"]) == ["open and cut &am"]
    assert html_text.host_texts(["<p>a<p>b"]) == ["a\n\nb"]


def test_host_repeats():
    """Without markup, what all pages of a host repeat goes; unique runs stay; article text that few pages share stays."""
    notice = "this site belongs to the example group of sites and keeps all rights reserved"
    pages = [f"<div>{notice}</div><div>page {i} tells its own story number {i * 7} {notice}</div>" for i in range(8)]
    assert html_text.host_texts(pages) == [f"page {i} tells its own story number {i * 7}" for i in range(8)]
    passage = "one passage of ten words that two of the pages share"
    articles = [f"<article><p>{passage}</p><p>own {i}</p></article>" if i < 2 else f"<article><p>other {i} text</p></article>" for i in range(8)]
    assert html_text.host_texts(articles)[0] == f"{passage}\n\nown 0"


def test_suffix_order():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 200)
    order, rank = html_text.suffix_order(tokens, 8)
    key = lambda i: tuple(tokens[i : i + 8])
    assert [key(i) for i in order] == sorted(key(i) for i in range(200))
    page = np.repeat(np.arange(10), 20)
    cover = html_text.repeated(tokens, page, length=4)
    holds = collections.defaultdict(set)
    for i in range(197):
        if page[i] == page[i + 3]:
            holds[tuple(tokens[i : i + 4])].add(page[i])
    expected = np.zeros(200, int)
    for i in range(197):
        if page[i] == page[i + 3]:
            expected[i : i + 4] = np.maximum(expected[i : i + 4], len(holds[tuple(tokens[i : i + 4])]))
    assert (cover == expected).all()


def test_main_texts(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, PAGE), (3, "http://a.example/y", None), (4, "no url", ""), (1, "http://a.example/x", PAGE)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id bigint, url string, html string, host string, text int")
    got = html_text.main_texts(df).collect()
    assert sorted(r.page_id for r in got) == [1, 1, 2, 3, 4]
    assert all((r.text == "") == (r.page_id in (3, 4)) and r.n_chars == len(r.text) for r in got)
    assert html_text.main_texts(df.limit(0)).count() == 0


def test_url_filter(spark):
    rows = [
        (1, "http://www.example.com/en/a?x"), (2, "https://EXAMPLE.com/en/"), (3, "http://b.example.com/fr/"), (4, "http://x.net/es/1"), (5, "http://x.net/xxx"), (6, "http://x.org/xxxy"), (7, "http://x.org/cheap-loans"),
        (8, "http://x.org/cheap"), (9, None), (10, ""), (11, "no scheme/porn"), (12, "http://x.org"), (13, "http://porn.org#en"), (14, "ftp://u://x/en/"), (15, "http://x.org/free?win"), (16, "http://notexample.com/en/"),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, host string")).collect()}
    assert got == {
        1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 2: ("example.com", "/en/", "example.com/en/", "block"), 3: ("b.example.com", "/fr/", "com/", "allow"), 4: ("x.net", "/es/1", "net/es/", "block"),
        5: ("x.net", "/xxx", None, "block"), 6: ("x.org", "/xxxy", None, "allow"), 7: ("x.org", "/cheap-loans", None, "block"), 8: ("x.org", "/cheap", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"),
        11: ("", "", None, "allow"), 12: ("x.org", "", None, "allow"), 13: ("porn.org", "", None, "block"), 14: ("u:", "//x/en/", None, "allow"), 15: ("x.org", "/free", None, "allow"), 16: ("notexample.com", "/en/", "com/", "allow"),
    }


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_as_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, DATA)
    result = con.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(result.fetchall(), key=repr)


def brute(rows, cosine):
    up, links = {}, {i: 0 for i, _, _ in rows}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    good = {}
    for i, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, float)
            good[i] = (x / np.sqrt(x @ x), label)
    ids = sorted(good)
    for p in range(len(ids)):
        for q in range(p):
            (x, a), (y, b) = good[ids[p]], good[ids[q]]
            if a == b and len(x) == len(y) and x @ y >= cosine:
                links[ids[p]] += 1
                links[ids[q]] += 1
                r, s = root(ids[p]), root(ids[q])
                if r != s:
                    up[max(r, s)] = min(r, s)
    return {i: (links[i], root(i), root(i) == i) for i in links}


@pytest.mark.parametrize("block", [512, 7])
def test_embeddings(spark, block):
    rng = np.random.default_rng(3)
    rows, centres = [], rng.normal(size=(9, 6))
    for i in range(240):
        c = centres[rng.integers(9)]
        rows.append((i, (c + rng.normal(scale=rng.choice([0.05, 0.2, 0.5]), size=6)).tolist(), int(rng.integers(3))))
    rows += [(300 + k, rows[k][1], rows[k][2]) for k in range(0, 40, 2)] + [(400 + k, rows[7][1], rows[7][2]) for k in range(30)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 6, 1), (503, [1.0, None, 0.0], 1), (504, [float("nan")] * 6, 1), (505, [float("inf")] * 6, 1), (506, rows[0][1], None), (507, [1.0, 2.0], 1), (508, [1.0, 2.0], 1), (509, [1e-300] * 6, 2), (510, [1e300] * 6, 2)]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id bigint, embedding array<double>, label int, id string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(df, block=block).collect()}
    expected = brute([r for r in rows if r[0] not in (509, 510)], 0.93)
    assert {k: v for k, v in got.items() if k < 509} == expected
    assert got[509] == (1, 509, True) and got[510] == (1, 509, False)


def test_embeddings_edges(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.embedding_components(none).count() == 0
    only = spark.createDataFrame([(1, None, 1)], "vec_id bigint, embedding array<float>, label int")
    assert [(r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(only).collect()] == [(0, 1, True)]


def test_schedule_skips_far_blocks():
    boxes = [(k, "a", [float(k), 0.0], [k + 0.5, 1.0]) for k in range(40)] + [(k, "b", [0.0, 0.0], [9.0, 9.0]) for k in range(40, 43)]
    pairs = embedding_dedup.schedule(boxes, 0.6)
    near = {(x, y) for x in range(40) for y in range(x, 40) if y - x <= 1} | {(x, y) for x in range(40, 43) for y in range(x, 43)}
    assert {(min(p), max(p)) for p in pairs} == near and len(pairs) == len(near)


# ---- host-wide repeats


def paged(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, host string")


def plain_site(n, host="a.example"):
    """Pages without any mark of what is boilerplate, some of them long; a notice and a menu line on all, a passage on few."""
    notice = "this site belongs to the example group of sites and keeps all rights reserved"
    menu = "home about news contact imprint privacy terms jobs press and so on"
    passage = "one passage of ten words that two of the pages share"
    pages = [f"<div>{menu}</div><div>{passage + ' ' if i < 2 else ''}page {i} tells its own story number {i * 7} {' '.join(f'w{i}x{k}' for k in range(40))} {notice}</div>" for i in range(n)]
    own = [f"{passage + ' ' if i < 2 else ''}page {i} tells its own story number {i * 7} {' '.join(f'w{i}x{k}' for k in range(40))}" for i in range(n)]
    return [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], own


@pytest.mark.parametrize("host_bytes", [4 << 20, 4000, 1500])
@pytest.mark.parametrize("tasks", [1, 16])
def test_main_texts_do_not_depend_on_tasks_or_buckets(spark, monkeypatch, host_bytes, tasks):
    monkeypatch.setattr(html_text, "parts", lambda *_: tasks)
    rows, own = plain_site(40)
    few = [(100 + i, f"http://few.example/{i}", p) for i, (_, _, p) in enumerate(rows[:3])]
    got = {r.page_id: r for r in html_text.main_texts(paged(spark, rows + few), host_bytes=host_bytes).collect()}
    assert [got[i].text for i in range(40)] == own
    assert all(got[i].n_repeated == 14 + 12 for i in range(40))
    assert [got[100 + i].n_repeated for i in range(3)] == [0, 0, 0]  # three pages tell nothing


@pytest.mark.parametrize("host_bytes", [24_000, 9_000, 300])
def test_main_texts_of_a_dealt_host_are_those_of_one_array(spark, host_bytes):
    """Notice k, short or long, stands on k of 60 pages, so buckets that hold it once decide which notices reach a share."""
    places = np.random.default_rng(5).permuted(np.tile(np.arange(60), (60, 1)), axis=1)
    notices = [[f"n{k}x{j}" for j in range(10 if k % 2 else 3)] for k in range(61)]
    on = [[k for k in range(1, 61) if i in places[k - 1, :k]] for i in range(60)]
    page = lambda i: "".join(f"<p>{' '.join(notices[k])}{f' own{i}x{k}' if k % 4 == 1 else ''}</p>" for k in on[i])
    sites = {"plain.example": [page(i) for i in range(60)], "article.example": [f"<article>{page(i)}</article>" for i in range(60)], "few.example": [page(i) for i in range(6)]}
    rows = [(100 * n + i, f"http://{host}/{i}", p) for n, (host, pages) in enumerate(sites.items()) for i, p in enumerate(pages)]
    got = {r.page_id: (r.text, r.n_repeated) for r in html_text.main_texts(paged(spark, rows), host_bytes=host_bytes).collect()}
    for n, pages in enumerate(sites.values()):
        assert [got[100 * n + i] for i in range(len(pages))] == list(zip(*html_text._cut(pages)))
    left = lambda first: {k for r in range(first, first + 60) for k in range(1, 61) if notices[k][0] in got[r][0].split()}
    assert left(0) == set(range(1, 18))  # 18 of 60 pages are three tenths
    assert left(100) == set(range(1, 54)) | {57}  # 54 are nine tenths; a block with a word of its own stays


def test_repeats_decide_where_structure_does_not(spark):
    """On real pages, their marks taken off, the suffix arrays find menus and footers that structure alone keeps; with the marks both agree."""
    import re

    rows = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL ORDER BY page_id LIMIT 60").fetchall()
    frame_ = "<div>{}</div><div>read more of what our writers say about things every day of the week here</div>"
    bare = []
    for i, h in rows:
        article = re.search("(?s)<article>(.*)</article>", h)[1]
        bare.append(f"<body><div>the daily example home news sport weather culture travel more sections</div>{article}{frame_.format('written by the staff of the daily example and friends of the house')}</body>")
    with_, without = html_text.host_texts(bare), html_text.host_texts(bare, repeats=False)
    wanted = html_text.host_texts([f"<article>{re.search('(?s)<article>(.*)</article>', h)[1]}</article>" for _, h in rows], repeats=False)
    assert with_ == wanted and all(a != b for a, b in zip(with_, without))
    marked = [h for _, h in rows]
    assert html_text.host_texts(marked) == html_text.host_texts(marked, repeats=False) == wanted


def test_window_counts_of_buckets_are_those_of_repeated():
    rng = np.random.default_rng(8)
    pages = ["<div>" + " ".join(rng.choice(list("abc"), 30)) + "</div><p>x y</p>" for _ in range(12)]
    streams = html_text.Streams(pages)
    at, names = streams.windows()
    held = collections.defaultdict(set)
    for place, name in zip(at, names):
        held[name].add(streams.page[place])
    counts = html_text._page_counts(streams)
    assert [len(held[n]) for n in names] == counts[at].tolist()


@pytest.mark.parametrize("text", ["<a ", "<a b='", "<a \">\" ", "</p", "<div>", "<p x=\"", "<!--", "<script>", "&amp", "<a b=c d", "x" * 5, "<span class=ad>"])
def test_broken_pages_take_linear_time(text):
    import time

    page = text * ((1 << 20) // len(text))
    began = time.perf_counter()
    html_text.page_blocks(page)
    assert time.perf_counter() - began < 5


def test_tag_ends():
    texts = lambda p: html_text.host_texts([p])[0]
    assert texts("<p title='a>b'>x</p>") == "x" and texts('<p title="quote>y</p>') == "y"
    assert texts("<p>a < b</p><p>c <3 d</p>") == "a < b\n\nc <3 d"
    assert texts("<p>x</p><p") == "x\n\n<p" and texts("<SCRIPT>var a='</p>'</SCRIPT><P>z</P>") == "z"
    assert texts("<p>one<span class='ad'>buy</span>two</p>") == "one\n\ntwo"


def test_blocks_are_skipped_in_clustered_data(spark):
    """More than half of a label's block pairs are provably distant, no link is lost."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(scale=0.03, size=(3000, 24))
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    classes = spark.createDataFrame([(i, "24/a", 1, bytearray(u.tobytes())) for i, u in enumerate(unit)], "id bigint, label string, copies bigint, unit binary")
    eps = float(np.sqrt(2 - 2 * 0.93)) + 1e-9
    blocks, _ = embedding_dedup.blocked(classes, eps, 8, 64)
    n = blocks.count()
    pairs = embedding_dedup.block_pairs(blocks.drop("ids", "copies", "units", "part", "place"), eps, 8).count()
    assert pairs < 0.5 * n * (n + 1) / 2
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(df, block=64).collect()}
    links = unit @ unit.T >= 0.93
    assert {i: v[0] for i, v in got.items()} == {i: int(links[i].sum()) - 1 for i in range(3000)}
    assert len({v[1] for v in got.values()}) == len({c for c in brute_roots(links)})


def brute_roots(links):
    root = np.arange(len(links))
    while True:
        new = np.array([root[row].min() for row in links])
        if (new == root).all():
            return root.tolist()
        root = new


def test_interval_recursion_finds_what_the_list_does(spark):
    rng = np.random.default_rng(9)
    low = rng.uniform(0, 10, (150, 3))
    boxes = [(i, "ab"[i // 90], low[i].tolist(), (low[i] + rng.uniform(0, 1, 3)).tolist()) for i in range(150)]
    frame_ = spark.createDataFrame([(label, i, *a, *b) for i, label, a, b in boxes], "label string, number bigint, " + ", ".join(f"{e}{j} double" for e in ("low", "high") for j in range(3)))
    got = {(r.x, r.y) for r in embedding_dedup.block_pairs(frame_, 1.5, 3).collect()}
    assert got == {(min(p), max(p)) for p in embedding_dedup.schedule(boxes, 1.5)}
