"""Main text of pages: by hand, and against a plain reading of the given pages."""

import html
import re
import time

import numpy as np
import pytest

from surveyloom.llm.main_text import THRESHOLD, extract_main_text, main_text, path_scores
from surveyloom.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"
LONG = "First words of a paragraph, which goes on for a while. It has two sentences."


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("plain text only", "plain text only"),
    ("<nav><a href=x>Home</a></nav>", ""),
    (f"<article><h1>T</h1><p>{LONG}<p>Short.</article>", f"T\n\n{LONG}\n\nShort."),
    (f"<article>a<br>b <b>c</b>d &amp; &lt;p&gt; &eacute;&#233;\n\t e<p>{LONG}</article>", f"a b cd & <p> éé e\n\n{LONG}"),
    (f"<div class=content><h1>T</h1><p>{LONG}</p></div><div class='sidebar x'><p>{LONG}</p></div>", f"T\n\n{LONG}"),
    (f"<article><p>{LONG}</p></article><div id=comments><article><p>{LONG * 9}</p></article></div>", LONG),
    (f"<article><p>{LONG}</p><ul><li>one<li>two</ul><form><p>Mail?</form><aside>x</aside></article>", f"{LONG}\n\none\n\ntwo"),
    (f"<header><h1>Site</h1></header><article><header><h1>T</h1><p>by</header><p>{LONG}</article>", f"T\n\n{LONG}"),
    (f"<article><p>{LONG}<script>var t='</p><p>x';</script> end<!-- <p>no</p> --></p></article>", f"{LONG} end"),
    (f"<article><p>{LONG}</p><div class='ad'>Buy it, now.</div><div class='cookie-notice'>We use cookies.</div></article>", LONG),
    (f"<article><p>{LONG}</p><p>cut <a href=\"x", f"{LONG}\n\ncut"),
    (f"<article><p>{LONG}</p><table><tr><td>a<td>b<tr><td>c</table></article>", f"{LONG}\n\na b\n\nc"),
    (f"<article><p>{LONG}</p><p hidden>no</p><p style='display: none'>no</p></article>", LONG),
])
def test_by_hand(page, text):
    assert main_text(page) == text


def test_plain_markup_is_told_by_paths():
    menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(12))
    body = "".join(f"<p>{LONG} Number {i}, again.</p>" for i in range(6))
    page = f"<body><div><ul>{menu}</ul></div><div><div><h2>Title</h2>{body}<p>Yes.</p></div></div><div><span>All rights</span></div></body>"
    got = main_text(page).split("\n\n")
    assert got[0] == "Title" and got[-1] == "Yes." and len(got) == 8


def test_scores_of_paths():
    paths = np.array([1, 1, 1, 2, 2, 2, 3])
    said = np.array([5.0, 5, 5, 300, 10, 250, 8])
    score = path_scores(paths, said, np.array([0.0, 0, 0, 6, 0, 5, 0]))
    reach = THRESHOLD * np.average(score, weights=said)
    assert score[3] == score[4] == score[5] > reach > max(score[0], score[6])


def test_given_pages(spark):
    """The pages have one article each, whose tags can be read by a plain expression."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op13_main_text"](spark, FOLDER).collect()}
    assert len(got) == len(pages)
    for r in pages:
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = [re.sub(r"<[^>]+>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_nulls_repeats_and_other_columns(spark):
    page = f"<article><p>{LONG}</p></article>"
    rows = [(None, None, None, "a"), (1, "u", "", "b"), (1, "u", page, "c"), (1, "u", page, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main_text(pages).collect()
    assert [(r["page_id"], r["text"], r["main_text"]) for r in got] == [(None, "a", ""), (1, "b", ""), (1, "c", LONG), (1, "c", LONG)]
    assert extract_main_text(pages.filter("false")).count() == 0
    with pytest.raises(ValueError):
        extract_main_text(pages, name="text")


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "x", '<a "' * 100_000, '<a href="' * 100_000, "<p><b>a, b." * 50_000,
    "<div>" + "<b>" * 50_000 + "</i><li>" * 5_000, "<" * 300_000, "<!--" * 100_000, "</p>" * 100_000 + "<p>x",
    "<script>" * 50_000, "<ul><li>" * 30_000 + "</ul>" * 30_000, "<i>" * 20_000 + "<a>x</b>" * 20_000, "<p>" + LONG * 20_000,
])
def test_long_and_broken_pages_take_linear_time(page):
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 20
