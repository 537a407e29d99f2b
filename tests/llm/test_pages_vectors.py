"""Operators on pages, URLs, vectors and edges."""

from __future__ import annotations

import itertools
import random

import duckdb
import numpy as np
import pytest

from assayframe.llm import page_diff, srs_search, url_rules
from assayframe.llm.components import components

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>menu</a></ul></nav>"
    "<div class='ad'>buy</div>%s<footer>&copy; host</footer></body></html>"
)


def text_of(body, page=PAGE):
    return page_diff.main_text(page_diff.lines_of(page % body), set())


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("<article><h1>A &amp; B</h1><p>one\n  two<br>three<p>four &lt;x&gt;</article>", "A & B\none two three\nfour <x>"),
        ("<article><p>in</p><aside>no</aside><form>no</form><script>no</script><div class='post-comments'>no</div><p>out</article>", "in\nout"),
        ("<main><div id='cookie-notice'>no</div><p>yes</p></main><section class='sidebar'>no</section>", "yes"),
        ("<article class=comment>no</article><article>yes</article>", "yes"),
        ("<div>bare <b>text</b></div><!-- no --><p>2 < 3</p>", "bare text\n2 < 3"),
        ("<article><p>cut &am</p><p>unclosed <i>tag", "cut &am\nunclosed tag"),
        ("<p a=\">\" b='x'>quoted</p></div></p>", "quoted"),
        (
            "<article><h2 id='related-work'>Related work</h2><p class='share-price'>up</p><p id='search-for-truth'>yes</p><p class=advert>no</p>"
            "<div class='share-buttons'>no</div><h3 class=notice>kept</h3></article>",
            "Related work\nup\nyes\nkept",
        ),
        ("", ""),
    ],
)
def test_main_text(body, expected):
    page = PAGE.replace("<footer>&copy; host</footer></body></html>", "") if "unclosed" in body else PAGE
    assert text_of(body, page) == expected


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        found = page_diff.common_lines(a, b)
        kept = [a[i] for i in sorted(found)]
        left = iter(b)
        assert all(line in left for line in kept)  # a subsequence of the other
        best = max((n for n in range(len(a) + 1) for c in itertools.combinations(a, n) if (it := iter(b)) and all(x in it for x in c)), default=0)
        assert len(kept) == best


def test_differencing_deletes_what_neighbours_share(spark):
    def page(i, words):
        return f"<div><p>Site name</p><p>Top bar</p><p>build {i}</p><p>Top end</p></div><div><p>{words}</p><p>more {words}</p></div><div>Imprint</div>"

    rows = [(i, f"http://h.example/a/{i}", page(i, f"story{i}"), "x") for i in range(6)]
    rows += [(100, "http://lone.example/", page(100, "lone"), "x"), (101, None, page(101, "nowhere"), "x"), (102, "http://h.example/a/9", None, "x")]
    rows += [(103, "http://copy.example/1", page(7, "same"), "x"), (104, "http://copy.example/2", page(7, "same"), "x")]
    got = {r["page_id"]: r for r in page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string").coalesce(1)).collect()}
    assert len(got) == len(rows)
    paired = [got[i]["text"] for i in range(6) if got[i]["n_shared"]]
    assert len(paired) >= 4 and all(text == f"story{i}\nmore story{i}" for i, text in ((i, got[i]["text"]) for i in range(6) if got[i]["n_shared"]))
    assert got[102]["text"] == "" and got[102]["n_chars"] == 0
    for key in (100, 101, 103, 104):  # nothing to compare with
        assert got[key]["n_shared"] == 0 and got[key]["text"].startswith("Site name") and got[key]["n_chars"] == len(got[key]["text"])
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_diff.extract(empty).count() == 0


def test_differencing_asks_menus_and_footers_too(spark):
    def page(i):
        return PAGE % f"<article><p>quoted by all</p><p>story{i}</p></article>"

    rows = [(i, f"http://h.example/{i:02}", page(i)) for i in range(20)] + [(50, "http://h.example/05", page(5)), (None, "http://h.example/07", page(7))] * 3
    rows += [(60, "http://long.example/" + "x" * 20_000, "<div>" + "<p>word</p>" * 20_000 + "</div>"), (61, "http://long.example/", "<div><p>word</p></div>")]
    got = page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert len(got) == len(rows)
    assert all(r["text"].startswith("quoted by all\nstory") for r in got if r["url"].startswith("http://h."))
    assert sum(r["n_shared"] >= 3 for r in got if r["url"].startswith("http://h.")) >= 20
    assert {r["page_id"]: r["n_lines"] for r in got if r["page_id"] in (60, 61)} == {60: 20_000, 61: 1}


def test_raw_elements_end_where_they_are_closed():
    article = "<article><p>one</p>%s<p>two</p></article>"
    for raw in ("<svg viewBox='0 0 1 1' />", "<iframe/>", "<svg><path d='x'/>no</svg>", "<button>no</button>", "<svg><svg>no</svg>no</svg>", "<script>'<svg>'</script>"):
        assert text_of(article % raw) == "one\ntwo", raw
    assert text_of(article % "<button>a <b>bold</b>") == "one\na bold\ntwo"
    assert text_of((article % "<select>") + "<div><select><option>no</select></div>") == "one\ntwo"
    assert text_of(article % "<button-bar>yes</button-bar>") == "one\nyes\ntwo"
    assert text_of(article % "<textarea>no") == "one"


def test_differencing_does_not_depend_on_the_number_of_tasks(spark):
    def page(i):
        return f"<div><p>Site name</p><p>Top bar</p><p>build {i}</p><p>Top end</p></div><div><p>story{i}</p><p>more story{i}</p></div><div>Imprint</div>"

    rows = [(i, f"http://h{i % 3}.example/a/{i}", page(i)) for i in range(30)]
    rows += [(100 + i, f"http://two{i // 2}.example/{i}", page(i)) for i in range(12)]
    rows += [(200 + i, "http://copies.example/x", page(i // 2)) for i in range(8)] + [(300, None, page(0)), (301, "http://h0.example/b", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for tasks in (1, 7, 200):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            found.append(sorted(map(tuple, page_diff.extract(frame.repartition(5)).collect())))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    assert all(row[2] == f"story{row[0] % 100}\nmore story{row[0] % 100}" for row in found[0] if row[0] < 112)


URLS = [
    "http://a.net/en/x", "https://WWW.Example.NET/en/1?q=/de/", "http://example.com/de/", "http://example.com/de", "http://sub.example.com/de/a#b", "http://x.org/fr/z",
    "http://free-bets.example.com/en/1", "http://casinoroyal.example.com/", "http://m.casino-win.example.org/fr/2", "http://a.net", "net/", None, "", "no scheme casino",
    "http://notexample.com/de/", "ftp://ads.example.com/ads/x", "http://h/?http://casino.com/", "http://é.example.net/en/ü", "x://a://b.net/", "http://u\nv.net/\n/q",
]


def test_url_rules_equal_sql(spark):
    rows = [(i, url, "x") for i, url in enumerate(URLS * 2)]
    got = url_rules.judge_urls(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", [row[:2] for row in rows])
    assert sorted(map(tuple, got), key=repr) == sorted(db.execute(url_rules.judge_sql()).fetchall(), key=repr)
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(["cheap", "x"],), (["cheap"],), (["pills", "cheap"],)], "tokens array<string>")
    rules = [url_rules.PatternRule("cheap.pills", ("cheap", "pills")), url_rules.PatternRule("x", ())]
    assert {row["token"]: len(row["rules"]) for row in url_rules.token_index(urls, rules).collect()} == {"pills": 1, "": 1}


def brute_nearest(rows, k, every):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for query, q in usable:
        if query % every == 0:
            out[query] = sorted((-(v @ q), i) for i, v in usable if i != query)[:k]
    return out


@pytest.mark.parametrize("small_cells", [False, True])
def test_nearest(spark, monkeypatch, small_cells):
    if small_cells:
        for name, value in {"CELL_POINTS": 40, "CHUNK_QUERIES": 5, "LEAF": 6, "SAMPLE": 200}.items():
            monkeypatch.setattr(srs_search, name, value)
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((12, 16))
    rows = [(i, (centers[i % 12] + 0.2 * rng.standard_normal(16)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # one very common vector
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, []), (None, rows[1][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cell int").repartition(3)
    found: dict = {}
    for row in srs_search.nearest(frame, k=20, every=20).collect():
        found.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    expected = brute_nearest([r for r in rows if r[1] != []], 20, 20)
    assert found.keys() == expected.keys()
    hits = 0
    for query, best in expected.items():
        ranked = sorted(found[query])
        assert [r for r, _, _ in ranked] == list(range(1, 21))
        assert ranked == sorted(ranked, key=lambda x: (-x[2], x[1]))
        hits += len({i for _, i in best} & {i for _, i, _ in ranked})
    assert hits >= 0.95 * 20 * len(expected)


def test_nearest_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in srs_search.nearest(few).collect())
    assert got == [(1, 1, 0.5), (2, 2, 0.5)]
    assert srs_search.nearest(few.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(300)]
    rng.shuffle(chain)
    edges = [*chain, (1000, 1001), (1001, 1000), (2000, 2000), (1000, 1002), *[(3000, 3000 + i) for i in range(1, 200)]]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(3)}, **{3000 + i: 3000 for i in range(200)}}
