import html
import re
import time

import duckdb
import pytest

from trunkwatch.llm.html_text import extract_main_text, host_templates, main_text, parse, subtrees

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><header class="site">Site</header><!-- <p>no</p> --><div class="ad">Buy</div>
<article><header>By me</header><h1>Caf&eacute; &amp; more</h1><p>One  two\n three<br>four <b>bold</b>ly, <a href="#">a link</a>.
<p>Unclosed <div class="share-buttons">Tweet</div><ul><li>first<li>second</ul><aside>Aside</aside>
<table><tr><td>a</td><td>b</td></tr></table><form>Mail <input value="x"></form><p hidden>gone</p>
<section id="comments"><article>Nice!</article></section><p class="readable add">kept &#x41;&lt;&nbsp;1 < 2</article>
<div id="cookie-notice">We use cookies</div><footer>&copy; Site</footer>"""


def test_article_without_the_rest():
    assert main_text(parse(PAGE)) == ("Café & more One two three four boldly, a link. Unclosed first second a b kept A< 1 < 2")


@pytest.mark.parametrize("page, text", [("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("<div>a", "a"), ("</p></div>x", "x"),
                                        ("<main><p>m</p></main><p>out</p>", "m"), ("<article>1</article><article>2</article>", "1 2"),
                                        ("<nav><ul><li>x<article>y", "y"), ("a<br/>b<span>c</span>d", "a bcd"), ("<p>x</b></i> y", "x y"),
                                        ("<script>if (a<b) {", ""), ("<!-- open", ""), ("<p title='a>b'>c</p>", "c"), ("a &unknown; &amp", "a &unknown; &"), ("<a t='x>y</a>z", "yz"), ("<a t=x'>y</a>z", "yz")])
def test_broken_pages(page, text):
    assert main_text(parse(page)) == text


def test_deep_nesting():
    assert main_text(parse("<div>" * 50_000 + "x")) == "x"


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "</i>" * 100_000, "<b>" * 100_000 + "<li>x" * 100_000, "<p><b>" * 100_000,
                                  "<ul><li>" * 100_000 + "</p>" * 100_000, "<td><b></table>" * 100_000, "<a <a '" * 50_000,
                                  "<div>" * 100_000 + "</span></div>" * 100_000, "<" * 300_000, "<!--" * 100_000, "<article><p>" * 50_000 + "</article>"])
def test_long_broken_pages_take_linear_time(page):
    began = time.process_time()
    main_text(parse(page))
    assert time.process_time() - began < 20


@pytest.mark.parametrize("part, kept", [
    ('<p class="related-work">Others did so.</p>', "Others did so."), ('<div class="search-results"><p>Ten of them.</p></div>', "Ten of them."),
    ('So <span class="alert">mind</span> it', "So mind it"), ("<label>Height</label> 3", "Height 3"), ("<math><mi>x</mi></math>", "x"),
    ("<header><h1>Title</h1><p>By me, today</p></header>", "Title"), ("<svg><title>Figure</title><text>axis</text></svg>", "Figure axis"),
    ('<div class="comments"><p>A long comment of a reader.</p></div>', ""), ('<div class="related"><a href="#">More</a></div>', ""),
    ('<p class="ad">Buy</p>', ""), ('<div id="cookie-notice"><p>We use cookies.</p></div>', ""), ('<span class="sponsored">Buy</span>', ""),
    ('<div class="share"><a href="#">Tweet</a></div>', ""), ("<p hidden>gone</p>", ""), ('<div class="site header"><p>Sub title</p></div>', "Sub title"),
    ("<form><label>Mail</label></form>", "")])
def test_parts_of_an_article(part, kept):
    assert main_text(parse(f"<article><p>Start.</p>{part}<p>End.</p></article>")) == " ".join(f"Start. {kept} End.".split())


def test_hash_of_a_subtree_depends_on_its_tags_and_text():
    one, two = parse("<div><p>a  b</p></div><p>c</p>"), parse("<section><div>\n<p>a b</p></div></section><p>d</p>")
    assert len(subtrees(one) & subtrees(two)) == 2


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, (u, h) in enumerate(rows)],
                                 "page_id long, url string, html string, host string, template string")


def test_templates_are_counted_by_host(spark):
    rows = [(f"http://a.x/{i}", f"<div>Welcome</div><p>Text {i}</p><p>{'Same' if i < 3 else i}</p>") for i in range(8)]
    rows += [(f"http://b.x/{i}", "<div>Welcome</div><p>b</p>") for i in range(3)] + [(None, None), ("", "<p>z</p>")]
    pages = pages_of(spark, rows).repartition(3)
    found = {r.host: len(r.template) for r in host_templates(pages).collect()}
    assert found == {"a.x": 1}
    texts = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    assert texts[0] == "Text 0 Same" and texts[7] == "Text 7 7" and texts[8] == "Welcome b" and texts[11] == "" and texts[12] == "z"
    assert len(texts) == 13 and extract_main_text(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    def page(i, article):
        return f"<script>track({i})</script><nav>Menu {i}</nav><article><h1>{article}</h1><p>Text of {article}</p></article>"

    rows = [("http://only.x/1", page(0, "one"))] * 6
    rows += [(f"http://half.x/{i}", page(i, "one" if i < 4 else f"other {i}")) for i in range(8)]
    rows += [("http://bare.x/1", "<h1>one</h1><p>Text of one</p>")] * 5
    pages = pages_of(spark, rows).repartition(3)
    texts = [r.text for r in extract_main_text(pages).orderBy("page_id").collect()]
    assert texts == ["one Text of one"] * 10 + [f"other {i} Text of other {i}" for i in range(4, 8)] + ["one Text of one"] * 5


def test_blocks_beside_the_main_part_go_by_number(spark):
    def page(i):
        notice = f"<div><div>Notice of {'one' if i < 6 else 'other' if i < 12 else i}</div></div>"
        return f"{notice}<section><p>Text {i} as it is.</p><p>{'A common line.' if i < 6 else i}</p></section>"

    texts = extract_main_text(pages_of(spark, [(f"http://a.x/{i}", page(i)) for i in range(40)]).repartition(3))
    expected = [("" if i < 12 else f"Notice of {i} ") + f"Text {i} as it is. {'A common line.' if i < 6 else i}" for i in range(40)]
    assert [r.text for r in texts.orderBy("page_id").collect()] == expected


def test_passages_of_an_article_stay_and_its_other_blocks_go_by_share(spark):
    rows = [(f"http://a.x/{i}", f"<article><h1>Title</h1><div>Read on</div><p>A long passage that near copies share.</p>"
                                f"<p><b>Bold</b> Edited {i}</p></article>") for i in range(8)]
    texts = extract_main_text(pages_of(spark, rows).repartition(3)).orderBy("page_id").collect()
    assert [r.text for r in texts] == [f"Title A long passage that near copies share. Bold Edited {i}" for i in range(8)]


def test_whole_small_table(spark):
    found = {r.page_id: r for r in extract_main_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for i, url, page in duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*)</article>", page, re.S).group(1)
        plain = re.sub(r"</?(?:b|a)\b[^>]*>", "", article)
        expected = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", plain)).split())
        assert (found[i].url, found[i].text) == (url, expected)
