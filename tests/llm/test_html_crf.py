import html
import random
import re

import time

import pytest

from furrow.llm import html_crf
from tests.llm.helpers import SF


def article(page):
    """The article's paragraphs of the tables' one layout, cut by patterns."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?p>|</?h1>|<br>", inside)]
    return "\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def field(spark):
    return html_crf.fit(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))


def test_query_against_patterns(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = html_crf.op3(spark, SF).collect()
    assert len(rows) == len(pages)
    right = sum(r["text"] == article(pages[r["page_id"]]["html"]) for r in rows)
    assert right >= 0.99 * len(rows)
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"] for r in rows)


def test_other_layouts_held_out(spark, field):
    rng, wrong, total = random.Random(123), 0, 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect():
        chain = html_crf.blocks(r["html"])
        y = html_crf.labels_by_markup(chain)
        main, other = [b.text for b, v in zip(chain, y) if v], [b.text for b, v in zip(chain, y) if not v]
        chain, y = html_crf.laid_out(main[:20], other, rng)
        wrong += sum(a != b for a, b in zip(field.viterbi(chain), y))
        total += len(y)
    assert wrong <= 0.02 * total


def test_viterbi_is_the_best_path(field):
    chain = html_crf.blocks("<body><nav>a</nav><article><h1>b c</h1><p>d e f.</p><aside>g</aside><p>h</p></article><footer>i</footer>")
    e = field.emissions(chain)
    score = lambda y: field.first[y[0]] + e[range(len(y)), y].sum() + sum(field.change[a, b] for a, b in zip(y, y[1:]))
    best = max((score([k >> i & 1 for i in range(len(e))]) for k in range(2 ** len(e))))
    assert score(field.viterbi(chain)) == pytest.approx(best)


def test_blocks():
    page = "<!doctype html><head><title>x</title></head><p>One &lt;two&gt;<br>three<p>four <b>five</b><script>var a='</p>'</script><!-- <p>no --><ul><li>six<li>seven</ul><div title=\"a>b\">eight</div>nine"
    assert [b.text for b in html_crf.blocks(page)] == ["One <two> three", "four five", "six", "seven", "eight", "nine"]


def test_awkward_rows(spark, field):
    long = "<article>" + "<p>words of a page</p>" * 30000
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p"), (4, "u", "a < b & c > d"), (5, "u", "<" * 5000), (6, "u", "<a href='" * 3000), (7, "u", long), (7, "u", long), (None, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_crf.extract(pages.withColumn("text", pages.url), field).collect()
    assert len(got) == len(rows)
    assert [r["text"] for r in got if r["page_id"] == 7] == ["\n".join(["words of a page"] * 30000)] * 2
    assert all(r["text"] == "" for r in got if r["page_id"] in (1, 2))
    assert html_crf.extract(pages.limit(0), html_crf.fit(pages.limit(0))).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>A</p><svg class=i/><p>B</p></article>", ["A", "B"]),
        ("<p>A</p><svg viewBox='0 0 1 1' /><p>B</p><svg><text>no</text></svg><p>C", ["A", "B", "C"]),
        ("<p>A</p><button-group><p>B</p></button-group><svg-icon></svg-icon><p>C</p>", ["A", "B", "C"]),
        ("<p>A</p><button type=button><p>B</p><select><p>C</p>", ["A", "B", "C"]),
        ("<p>A</p><script>no</script ><p>B</p><style>no</style/><p>C</p><script>no <p>no", ["A", "B", "C"]),
        ("<html><head><title>no</title><meta charset=x><body><p>A</p><p>B", ["A", "B"]),
        ("<html><head><title>no</title><link href=x><style>no</style>\n<div>A</div><p>B</p>", ["A", "B"]),
        ("<head>\n<script>no</script>A</head><p>B", ["A", "B"]),
        ("<head><title>no</title></head><body><header>A</header><p>B", ["A", "B"]),
    ],
)
def test_no_rest_of_a_page_is_dropped(page, want):
    assert [b.text for b in html_crf.blocks(page)] == want


def test_many_unclosed_hidden_elements():
    assert len(html_crf.blocks("<button><svg><p>x</p>" * 3000)) == 3000


def test_long_pages_are_learned_from(spark):
    body = lambda k: "".join(f"<p>Paragraph {i} of page {k} says what there is to say about it.</p>" for i in range(500))
    pages = [(k, None, f"<body><nav><a href='/'>Home</a></nav><article>{body(k)}</article><footer>About {k}</footer></body>") for k in range(12)]
    assert min(len(p[2]) for p in pages) > 20_000
    table = spark.createDataFrame([*pages, *pages], "page_id long, url string, html string")
    field = html_crf.fit(table)
    for r in html_crf.extract(table, field).collect():
        assert r["text"] == "\n".join(f"Paragraph {i} of page {r['page_id']} says what there is to say about it." for i in range(500))


def test_runs_are_bounded():
    for n in (1, 200, 201, 230, 5000):
        for key in (-(2**63), -3, 0, 2**63 - 1):
            runs = html_crf.runs_of([0] * (n // 2) + [1] * (n - n // 2), key)
            assert runs[0][0] == 0 and runs[-1][1] == n and sum(b - a for a, b in runs) <= 200
            assert all(b < c for (_, b), (c, _) in zip(runs, runs[1:]))


def test_nesting_takes_linear_time():
    start = time.time()
    for page in ("<div>x" * 100_000, "<b>" * 100_000 + "<p>x" * 100_000 + "</b>" * 100_000, "<div class='a'><p>x" * 100_000 + "</p></div>" * 100_000):
        assert len(html_crf.blocks(page)) == 100_000
    assert time.time() - start < 60


def foreign(k, n=6):
    """A page without an article element."""
    body = "".join(f"<p>Paragraph {i} of page {k} tells the reader at some length what there is to be said about matter {i * k}.</p>" for i in range(n))
    return f"<html><body><nav><a href='/'>Home</a> <a href='/n'>News</a></nav><div class='content'>{body}</div><div class='sidebar'><a href='/x'>Also read this</a></div><footer>About us {k}</footer></body></html>"


def wanted(k, n=6):
    return "\n".join(f"Paragraph {i} of page {k} tells the reader at some length what there is to be said about matter {i * k}." for i in range(n))


def test_pages_without_labels(spark):
    """No page has an article element, or half of them: none comes out empty."""
    rows = [(k, None, foreign(k)) for k in range(60)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_crf.extract(table, html_crf.fit(table)).collect()}
    assert sum(got[k] == wanted(k) for k in got) >= 54 and all(got.values())
    half = [(k, None, h.replace("<div class='content'>", "<article>").replace("</div><div class='sidebar'>", "</article><div class='sidebar'>") if k % 2 else h) for k, _, h in rows]
    table = spark.createDataFrame(half, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_crf.extract(table, html_crf.fit(table)).collect()}
    assert sum(got[k] == wanted(k) for k in got) >= 54 and all(got.values())
