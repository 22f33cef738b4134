import html
import random
import re
import time

import pytest

from marginalia.llm import html_text, queries
from marginalia.llm.webpages import Page


def test_held_out_pages():
    pages = [Page(987_000_000 + k) for k in range(300)]
    got = html_text.main_texts([p.html for p in pages], html_text.model())
    missed = extra = total = 0
    for page, text in zip(pages, got, strict=True):
        own = set(text.split("\n")) - {""}
        missed, extra, total = missed + len(page.kept - own), extra + len(own - page.kept), total + len(page.kept)
    assert missed <= 0.02 * total and extra <= 0.01 * total


def other_page(seed):
    """A page of another make than those learnt from: other words, names and layout, and no article element."""
    r = random.Random(seed)
    vocab = "water house seldom under green paper window garden letter small river stone people winter market signal before bright".split()
    said = lambda a, b: " ".join(r.choice(vocab) for _ in range(r.randint(a, b)))
    para = lambda: ". ".join(said(6, 18).capitalize() for _ in range(r.randint(2, 6))) + "."
    kept = [said(3, 9).capitalize()] + [para() for _ in range(r.randint(3, 14))]
    links = lambda n: "".join(f'<li class="item-{k}"><a href="/{k}">{said(1, 3)}</a></li>' for k in range(n))
    body = f"<h1 class='headline'>{kept[0]}</h1>" + "".join(f"<p>{x}</p>" if r.random() < 0.9 else f"<blockquote>{x}</blockquote>" for x in kept[1:])
    wrap = r.choice(['<div class="td-post-content">{}</div>', '<div id="ArticleBody">{}</div>', '<section class="storyText">{}</section>', '<div class="mw-parser-output">{}</div>', '<main><div>{}</div></main>'])
    before = r.choice(['<div id="siteHeader"><div class="logoBox">{}</div></div>', "<header><p>{}</p></header>"]).format(said(2, 5)) + r.choice(['<div class="navbarTop"><ul>{}</ul></div>', "<nav><ul>{}</ul></nav>"]).format(links(r.randint(4, 8)))
    side = r.choice(['<div class="sidebarRight"><h3>{}</h3><ul>{}</ul></div>', "<aside><h4>{}</h4><ul>{}</ul></aside>", '<div id="relatedLinks"><h3>{}</h3><ul>{}</ul></div>']).format(said(1, 3), links(r.randint(3, 7)))
    ad = r.choice(['<div class="advertBox"><p>{}</p></div>', '<div id="sponsoredContent">{}</div>', ""]).format(said(5, 20))
    notes = r.choice(['<div class="commentsArea"><h3>Comments</h3>{}</div>', '<section id="commentSection">{}</section>', ""]).format("".join(f'<div class="commentItem"><b>{said(1, 1)}</b><p>{para()}</p></div>' for _ in range(r.randint(1, 5))))
    foot = r.choice(['<div class="footerWrap"><p>&copy; {}</p></div>', "<footer>{}</footer>"]).format(said(4, 12))
    return f"<html><head><title>x</title></head><body><div id='outer'>{before}{ad}{wrap.format(body)}{side}{notes}</div>{foot}</body></html>", kept


def test_pages_of_another_make():
    pages = [other_page(k) for k in range(200)]
    missed = extra = total = 0
    for (_, kept), text in zip(pages, html_text.main_texts([p for p, _ in pages], html_text.model()), strict=True):
        own = set(text.split("\n")) - {""}
        missed, extra, total = missed + len(set(kept) - own), extra + len(own - set(kept)), total + len(set(kept))
    assert missed <= 0.05 * total and extra <= 0.05 * total


def test_what_counts_as_text():
    body = "A first paragraph of some length, with commas, and a point. " * 4
    page = f"<html><body><nav><a href=/>home</a></nav><article><h1>Title of it</h1><p>{body}<math><mi>x</mi>=<mn>2</mn></math> so.</p><p><noscript>{body}</noscript></p><p>{body}<svg><style>p</style><text>label</text></svg><object>{body}</object></p><script>no()</script></article></body></html>"
    text = html_text.main_texts([page], html_text.model())[0]
    assert "x=2 so." in text and "label" in text and text.count("A first paragraph") == 16 and "no()" not in text


@pytest.mark.parametrize("unit", ['<a "', "<!", "<a '\"", "<div></p>", "<ul><li>", '<b x=">', "<a <!-"])
def test_time_follows_the_length(unit):
    took = []
    for n in (1 << 18, 1 << 20):
        start = time.process_time()
        html_text.Nodes().add(0, unit * (n // len(unit)))
        took.append(time.process_time() - start)
    assert took[1] <= 4 * 3 * took[0] + 0.5


def test_numbers_of_any_length():
    assert html_text.unescaped("&#" + "9" * 9000 + "; &#00000000065; &#x0041; &amp;&#65") == "\ufffd A A &A"


def test_no_kept_node_below_a_dropped_one():
    n = html_text.Nodes()
    for k in range(50):
        n.add(k, Page(k).html)
    x, parent, levels = html_text.features(n, html_text.model().tokens)
    keep = html_text.decode(html_text.model().trees.logits(x), parent, levels)
    assert keep[parent[keep & (parent >= 0)]].all()


def test_awkward_pages(spark):
    article = "<article><h1>A title here</h1><p>First &amp; &lt;b&gt;\n  second&nbsp;word.<p>Unclosed <b>bold<br>text, and more of it here.</article>"
    rows = [
        (1, "u", None, 7), (2, "u", "", 7), (3, "u", "plain text only, no markup at all.", 7), (4, "u", article, 7), (4, "u", article, 7), (None, None, "<p", 7), (6, "u", "<div>" * 400 + "deep" + "</div>" * 400, 7),
        (7, "u", "<script>var x = '<p>no</p>'", 7), (8, "u", '<p class="unclosed>text', 7), (9, "u", "</p></div><!-- open", 7), (10, "u", "<article><p>" + "long text. " * 50_000 + "</p></article>", 7),
    ]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, extra int"))
    assert got.columns == ["page_id", "url", "extra", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    by = {r["page_id"]: r["text"] for r in found}
    assert by[1] == by[2] == "" and by[4] == "A title here\nFirst & <b> second word.\nUnclosed bold text, and more of it here."
    assert by[10] == ("long text. " * 50_000).strip()
    clash = spark.createDataFrame([(4, article, 5, "old")], "page_id long, html string, N_CHARS int, Text string")
    assert html_text.extract(clash).collect() == [(4, by[4], len(by[4]))]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op9_html_text(spark, sf_dir).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        assert r["text"] == "\n".join(b for b in blocks if b)
