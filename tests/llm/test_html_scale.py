"""Formulas, pages of menus alone, stray tags in linear time, a very long page; rows that are equal in all columns."""

import resource
import time

from pyspark.sql import functions as F

from lectern.llm import ctw_scoring, html_extract, substring_dedup
from lectern.llm.common import with_block

ARTICLE = "<body><article><h1>Title of it</h1><p>{}</p><p>And so it went on for a while, with a few more words in it, until the end.</p></article></body>"


def extracted(*pages):
    return html_extract.extract(list(pages), html_extract.model())


def test_formulas_are_text():
    inside = "Here <math><semantics><mrow><mi>x</mi><mo> = </mo><mn>42</mn></mrow><annotation encoding='t'>x=42</annotation></semantics></math> holds, as was to be shown above."
    assert extracted(ARTICLE.format(inside))[0].split("\n")[1] == "Here x = 42 holds, as was to be shown above."


def test_menus_alone_are_no_text():
    links = ['<a href="/a">Home</a>', '<a href="/b">About us</a>', '<a href="/c">Login</a>', '<a href="/d">Contact</a>']
    assert extracted(*[f"<body>{sep.join(links)}</body>" for sep in (" | ", "<br>", " ", "<hr>")], "<body><ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul></body>") == [""] * 5
    pages = html_extract.menu_pages(100, 99)
    assert sum(map(bool, extracted(*[p for p, _ in pages]))) <= 8  # a line of rights may stay


def test_loose_pages_still_read():
    pages = html_extract.loose_pages(150, 78)
    got = extracted(*[p for p, _ in pages])
    wrong = sum(len(set(g.lower().replace(",", " ").replace(".", " ").split()) ^ set(w.split())) for g, (_, w) in zip(got, pages, strict=True))
    assert wrong < 0.05 * sum(len(w.split()) for _, w in pages)


def test_stray_tags_take_linear_time():
    html_extract.model()
    n = 40_000
    for page in ("<div>" * n + "text" + "</section>" * n, "<select>" + "<div>" * n + "</select></table>" * n, "<a><div>" + "<b>x" * n + "</a>" * n, "<table>" + "<div>" * n + "<td>x" * n):
        began = time.time()
        extracted(page)
        assert time.time() - began < 8


def test_a_very_long_page():
    html_extract.model()
    n = 20 * (1 << 20) // 32
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = extracted("<article>" + "".join(f"<p>short paragraph {i}</p>" for i in range(n)) + "</article>")[0]
    assert got.count("\n") == n - 1 and got.endswith(f"short paragraph {n - 1}")
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 800 << 10


def test_ties_and_repeated_pages(spark):
    page = ARTICLE.format("A first part of it, which has some words too.")
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "u", None), (3, "u", " \n")]
    got = sorted(((x.page_id, x.text) for x in html_extract.digest(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()), key=str)
    assert [t for _, t in got] == [extracted(page)[0]] * 2 + ["", ""] + [extracted(page)[0]]


def test_equal_rows_are_spread(spark):
    """A hundred thousand rows of one text and no id are dealt to all blocks, and give the results they should."""
    n = 100_000
    rows = spark.range(n).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("one text of a few words").alias("text"))
    blocks = [x["count"] for x in with_block(rows, "text", "doc_id", block_bytes=1 << 16).groupBy("block").count().collect()]
    assert len(blocks) > 30 and max(blocks) < 2 * n / len(blocks)
    few = spark.range(300).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(" ".join(f"w{i}" for i in range(50))).alias("text"))
    assert [tuple(x) for x in substring_dedup.substring_dedup(few).select("n_words", "n_removed").distinct().collect()] == [(50, 50)]
    scored = ctw_scoring.ctw_scoring(few.limit(50)).select("n_tokens", "n_known", "train_tokens", F.round("score", 4)).distinct().collect()
    assert len(scored) == 1 and scored[0][0] == 51
