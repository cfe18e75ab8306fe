import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.llm import html_extract, labelled
from gridtide.llm.queries import page_texts

ARTICLE = "<p>This sentence, which is rather long, stands in the main text of the page.</p>" * 4


@pytest.fixture(scope="module")
def model(spark, small):
    return html_extract.fit(spark.read.parquet(f"{small}/pages.parquet"))


def text_of(model, page):
    tree = html_extract.Page(page)
    return html_extract.render(tree, html_extract.decode(tree.parent, model.scores(html_extract.describe(tree))))


def test_query_finds_the_articles(spark, small):
    """The pages of the test tables hold their text in one article element."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = page_texts(spark, small).collect()
    assert len(rows) == len(pages)
    for row in rows:
        inner = re.search("<article>(.*?)</article>", pages[row.page_id].html, re.S)[1]
        inner = re.sub("</?(h1|p|br)>", " ", inner)
        assert row.text == " ".join(html.unescape(re.sub("<[^>]*>", "", inner)).split())
        assert row.n_chars == len(row.text) and row.url == pages[row.page_id].url


def test_edges(spark, model):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, None, "<p", "x"), (None, "u", "plain words", "x"), (3, None, "<p", "x"), (4, "u", "<div>" * 3000 + "x", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = html_extract.extract(pages, model).collect()
    assert sorted((r.page_id for r in found), key=repr) == sorted((r[0] for r in rows), key=repr)
    assert all(r.text == "" for r in found if r.page_id in (1, 2))
    assert html_extract.extract(pages.limit(0), model).collect() == []
    assert len(html_extract.extract(pages, html_extract.fit(pages.limit(0))).collect()) == len(rows)


def test_text_rules(model):
    page = f"<body><nav><a href=x>Menu</a></nav><article><h1>A  &amp;&#32;B</h1><p>run<b>ning</b>\n on</p><script>x()</script>{ARTICLE}</article><footer>&copy; foot</footer></body>"
    text = text_of(model, page)
    assert text.startswith("A & B running on This sentence,")
    assert "Menu" not in text and "foot" not in text and "x()" not in text


@pytest.mark.parametrize("side", ["<div class='ad-box'>Buy this now</div>", "<section class='comments'><p>First! I love it.</p></section>", "<form><p>Subscribe</p><input></form>", "<aside><p>Related stories</p></aside>", "<div id='cookie-notice'>We use cookies</div>"])
def test_side_elements_go(model, side):
    text = text_of(model, f"<html><body><article><h1>Title</h1>{ARTICLE}</article>{side}</body></html>")
    assert text.startswith("Title This sentence") and text.count("This sentence") == 4
    assert re.sub("<[^>]*>", "", side)[:10] not in text


def test_decoding_is_the_best_consistent_labelling():
    random = np.random.default_rng(2)
    for _ in range(30):
        count = 9
        parent = [-1, *(int(random.integers(0, n)) for n in range(1, count))]
        chance = random.random(count)
        best = None
        for bits in range(2 ** (count - 1)):
            kept = [True, *(bool(bits >> (n - 1) & 1) for n in range(1, count))]
            if all(kept[parent[n]] or not kept[n] for n in range(1, count)):
                value = sum(np.log(chance[n] if kept[n] else 1 - chance[n]) for n in range(1, count))
                if best is None or value > best[0]:
                    best = value, kept
        assert html_extract.decode(parent, chance).tolist() == best[1]


def test_broken_markup_keeps_its_text(model):
    page = html_extract.Page("<div><p>a<div>b</p></b>c<ul><li>d<li>e</ul><table><tr><td>f<td>g</table></div>h")
    assert html_extract.render(page, np.ones(len(page.tag), dtype=bool)) == "a b c d e f g h"


def test_copies_of_a_page_do_not_enter_the_sample_again(spark, monkeypatch):
    page = lambda n: f"<html><body><article><p>Text {n} of this page, long enough.</p></article><nav><a href='/'>x{n}</a></nav></body></html>"
    rows = [(page(n),) for n in range(8)]
    sizes = []
    monkeypatch.setattr(html_extract.boosting, "fit", lambda x, y, **options: sizes.append(len(x)))
    for copies in (1, 200):
        html_extract.fit(spark.createDataFrame(rows + rows[:1] * (copies - 1), "html string"))
    assert sizes[0] == sizes[1] > 0


def test_text_of_embedded_and_hidden_elements_is_left_to_the_trees(model):
    body = "<p>Energy is <math>E</math> here <object>fallback</object></p><p hidden>hid</p><p style='display: none'>den</p><p>Press <button>Go</button> or <svg><text>draw</text></svg><noscript>plain</noscript></p>"
    for shown in (body, body.replace("<p", "<div").replace("</p", "</div")):
        text = text_of(model, f"<html><body><nav><a href='/'>Menu</a></nav><article><h1>T</h1>{ARTICLE}{shown}{ARTICLE}</article></body></html>")
        for words in ("Energy is E here fallback", "hid", "den", "Press or drawplain"):
            assert f" {words} " in text, words
        assert "Go" not in text and "Menu" not in text


CROSSING = {
    "inline around blocks": lambda n: "<b><div>" * n + "</b>" * n,
    "blocks around inline": lambda n: "<div><b>" * n + "</div>" * n + "x",
    "paragraph under blocks": lambda n: "<p><button>" + "<div>" * n + "x",
    "items under blocks": lambda n: "<li>" + "<ul><b>" * n + "<li>" * n,
    "unmatched ends": lambda n: "<i>" * n + "</b></u></p>" * n,
    "inline in turn": lambda n: "<b><i></b></i>" * n,
}


@pytest.mark.parametrize("kind", sorted(CROSSING))
def test_crossing_tags_take_linear_time(kind):
    seconds = []
    for count in (5_000, 50_000):
        text = CROSSING[kind](count)
        start = time.process_time()
        html_extract.Page(text)
        seconds.append(time.process_time() - start)
    assert seconds[1] < 5 and seconds[1] < 25 * max(seconds[0], 0.02)


def test_samples_hold_at_any_count(spark, small):
    mixed = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    for rows, count, low, high in ((100, 50, 200_000, 200_000), (600, 1_200, 98_000, 102_000), (600, 600 * 200, 900, 1100)):
        assert low <= mixed.filter(labelled.share(F.col("h"), rows, count)).count() <= high
    # A pretended table of 10^10 rows: the share is what it should be, not rounded to none.
    found = spark.range(1).select(F.lit(0).alias("h")).filter(labelled.share(F.col("h").cast("bigint"), 600, 10**10))
    assert found.count() == 1
    bound = (1 << 62) * 600 // 10**10
    edge = spark.createDataFrame([((bound - 1) << 2,), (bound << 2,)], "h bigint")
    assert edge.filter(labelled.share(F.col("h"), 600, 10**10)).count() == 1
    with pytest.raises(ValueError, match="empty"):
        labelled.require_some(0, spark.range(0), 10)
    labelled.require_some(0, spark.range(0), 0)


def test_an_empty_sample_is_an_error(spark, monkeypatch):
    pages = spark.createDataFrame([(f"<p>{n}</p>",) for n in range(9)], "html string")
    monkeypatch.setattr(labelled, "share", lambda mixed, rows, count: F.lit(False))
    with pytest.raises(ValueError, match="empty"):
        html_extract.fit(pages, sample_pages=3)
    docs = spark.createDataFrame([(n, f"t{n}") for n in range(9)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(9)], "doc_id bigint, toxic int")
    with pytest.raises(ValueError, match="empty"):
        labelled.sample(docs, labels, "toxic", 4, 2, rows=3)
