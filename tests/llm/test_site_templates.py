"""Templates of large hosts, their counts, and names inside articles."""

import random
from collections import defaultdict

import pytest

from lakeload.llm import html_extract


def test_box_on_half_a_percent_of_a_large_host(spark):
    rows = []
    for k in range(3000):
        box = "<div class='box'><span>Section notes</span></div>" if k % 200 == 0 else ""
        few = "<div class='few'>Only here</div>" if k % 400 == 1 else ""
        body = f"<body>{box}{few}<div><p>text {k} of it</p></div></body>"
        rows.append((k, f"https://a.example.org/{k}", body))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: (r["text"], r["n_templates"]) for r in html_extract.extract(pages).collect()}
    for k in range(3000):
        text = f"text {k} of it"
        assert found[k] == (f"Only here\n{text}" if k % 400 == 1 else text, int(k % 200 == 0))


def made_pages():
    """Hosts of different sizes whose boxes recur on some of their pages; copies of pages."""
    chance, rows = random.Random(9), []
    for k in range(160):
        host = chance.choice(["a", "a", "b", "c"])
        boxes = [f"<div class='x{b}'>box {b} of {host}<ul><li>item {b}</ul></div>" for b in range(6) if chance.random() < b / 8]
        body = f"<p>text {k % 140}</p>" + "".join(f"<section>{b}</section>" if chance.random() < 0.3 else b for b in boxes)
        rows.append((k, f"https://{host}.example.org/{k}", f"<body><article>{body}</article>{boxes[:1]}</body>"))
    return [*rows, *((500 + k, *rows[k][1:]) for k in range(30))]


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_counts_equal_a_plain_count(spark, monkeypatch, sent):
    monkeypatch.setattr(html_extract, "SENT_TEMPLATES", sent)
    rows = made_pages()
    articles = defaultdict(set)
    for _, url, page in rows:
        root = html_extract.parse(page)
        hashes = html_extract.subtree_hashes(root)
        article = tuple(hashes[id(n)] for n in html_extract._main(root))
        for node in html_extract.countable(root):
            articles[url.split("/")[2], hashes[id(node)]].add(article)
    common = defaultdict(set)
    for (host, subtree), seen in articles.items():
        if len(seen) >= html_extract.MIN_PAGES:
            common[host].add(subtree)
    want = {k: html_extract.main_text(page, frozenset(common[url.split("/")[2]])) for k, url, page in rows}
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = html_extract.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in found} == want and common
    assert 0 < sum(r["n_templates"] > 0 for r in found) < len(rows)


def test_names_inside_articles():
    page = (
        '<article><h1>T</h1><section id="related-work"><h2 id="social-impact">Impact</h2><p class="lead side">Body</p>'
        '</section><div class="share-box">x</div><div id="comments">y</div><section class="comments">z</section>'
        '<div id="forms-of-life">Life</div><ul class="social">w</ul><section class="search-methods">How</section>'
        "<p>tail</p></article>"
    )
    assert html_extract.main_text(page) == "T\nImpact\nBody\nLife\nHow\ntail"
