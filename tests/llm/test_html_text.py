import html
import re

import pyarrow.parquet as pq
import pytest
from conftest import SF  # noqa: F401  (tests/llm/conftest.py)

from caseflow.llm import html_text


def test_articles_of_the_pages_table(spark):
    want = {}
    for r in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r["html"], re.S)[1])
        parts = (" ".join(html.unescape(p).split()) for p in re.split(r"<[^>]*>", article))
        want[r["page_id"]] = " ".join(p for p in parts if p)
    got = {r["page_id"]: r for r in html_text.op1(spark, SF).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


PAGE = """<!doctype html><html><head><title>T &amp; x</title></head><body><header class="site"><a href=/>Home</a> My site, the best.</header>
<nav><a>One</a> <a>Two</a></nav><div id="cookie-notice">We use cookies. Accept them, please, now.</div><div class="wrap"><div class="content">
<h1>The title</h1><p>First paragraph, with <a href="x">a link</a> and more text.<p>Second   one &eacute;.<ul><li>item one<li>item two</ul>
<blockquote>Quoted text.</blockquote><div class="ad-box">Buy now! Cheap, cheap.</div><p>Short.</p></div><aside>Side, text. Long long text here.</aside>
<section class="comments"><h2>Comments</h2><p>I think, this is long. A reader comment, yes. And more, more, more text to fool you.</p></section>
<form><p>Sign up, please, today</p><input name=q></form></div><footer>(c) me</footer><script>if(a<b){x="</div>"}</script></body></html>"""


@pytest.mark.parametrize("page,text", [
    (PAGE, "The title First paragraph, with a link and more text. Second one é. item one item two Quoted text. Short."),
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p", ""), ("a<b>c</b>d<br>e", "acd e"), ("<!-- x", ""),
    ("<div>a<span>b</span></div>&lt;x&gt; &amp &am", "ab <x> & &am"), ("<p>one<p>two", "one two"),
    ("<body><main><header><h1>Head</h1></header><p>Text, here.</p></main><footer>no</footer>", "Head Text, here."),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<style>p{}</style><p>kept</p><script>var a='<p>no</p>'", "kept"),
    ("<form>" + "<p>Whole page in a form, with text.</p>" * 3 + "</form>", " ".join(["Whole page in a form, with text."] * 3)),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
])
def test_cases(page, text):
    assert html_text.main_text(page) == text


LONG = "Words of a sentence, and more of them, up to its end. " * 6
ROWS = "".join(f"<li>{LONG}</li>" for _ in range(5))


@pytest.mark.parametrize("inside", [
    f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><ul>{ROWS}</ul>",
    f"<div class=lead><p>Short lead.</p></div><div class=body><p>{LONG}</p><p>{LONG}</p></div>",
    f"<h1>Title</h1><p>Before it.</p><blockquote><p>{LONG}</p><p>{LONG}</p></blockquote><p>After it.</p>",
    f"<h2>Title</h2><p>Before it.</p><table><tr><td>{LONG}<td>{LONG}</table><p>After it.</p>",
    f"<section><h2>One</h2><p>Short one.</p></section><section class=b><h2>Two</h2><p>{LONG}</p></section>",
])
def test_article_without_a_tag_of_its_own_is_whole(inside):
    page = f"<body><nav><a href=/>Home</a></nav><div class=content>{inside}</div><div class=m><a href=1>More</a> <a href=2>Else</a></div></body>"
    assert html_text.main_text(page) == " ".join(re.sub("<[^>]*>", " ", inside).split())


@pytest.mark.parametrize("page,text", [
    ("<article><p>A</p><button>Share</button><p>B</p></article>", "A B"), ("<p>A <span class=ad>Buy</span> B <i hidden>no</i></p>", "A B"),
    ("<p>A <span style='display:none'>no</span>B <label>Name</label></p><select><option>x<option>y</select>", "A B"),
    ("<div>A <noscript>no</noscript> B <object>no</object>C</div>", "A B C"), ("<button><div>no</div></button>A<p>B <a href=x class=share>no</a>", "A B"),
])
def test_text_of_excluded_inline_elements_is_left_out(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page,text", [
    ("<!doctype html><html><head><title>T</title><meta charset=utf-8><body><p>Text, here.</p></body></html>", "Text, here."),
    ("<html><head><title>T</title><p>Text, here.</p>", "Text, here."), ("<head><title>T</title>Text, here.", "Text, here."),
    ("<head><noscript><style>p{}</style><p>no</p></noscript><p>yes</p>", "yes"), ("<body><p>one</p><head><p>two</p>", "one two"),
    ("<div class='content has-sidebar'><h1>T</h1><p>Text, here.</p></div>", "T Text, here."),
    ("<div id=page class='no-comments'><p>Text, here.</p></div>", "Text, here."),
    (f"<div class=social><h1>T</h1><p>{LONG}</p><div class=share-bar>Share it</div></div><div class=sidebar>Side</div>", f"T {LONG.strip()}"),
    (f"<div class=wrap><h1>T</h1><p>Text, here.</p></div><div id=comments><p>{LONG}</p></div>", "T Text, here."),
    (f"<article><p>Text, here.</p></article><div class=ad><p>{LONG}</p></div>", "Text, here."),
    (f"<div class='wrap nav-open'><article><p>{LONG}</p></article></div>", LONG.strip()),
    (f"<div class=comments-open><h1>T</h1><p>{LONG}</p></div>", f"T {LONG.strip()}"),
])
def test_heads_end_and_words_exclude_no_whole_page(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("inside", [
    "<h1><a href=/t>The title</a></h1><p>Text, here, and more of it.</p>", "<h3><a href=/s>A linked heading</a></h3><p>Text, here, and more.</p>",
    "<p>Text, here.</p><h2>References</h2><ol><li><a href=1>One, a book.</a></li><li><a href=2>Two, a paper.</a></li></ol>",
    "<h2 id=related-work>Related work</h2><p>Text, here.</p>", "<h2 id=Search_algorithms>Search algorithms</h2><p>Text, here.</p>",
    "<section id=social-impact><h2>Social impact</h2><p>Text, here.</p></section><p>More, here.</p>",
    "<div class=share-price>Price of a share, 12.</div><p>Text, here.</p>", "<p class=teaser>The teaser, first.</p><p>Text, here.</p>",
    "<p>So, <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><p>Text, here.</p>", "<div class=alert-fatigue><p>Text, here.</p></div><p>More.</p>",
])
def test_nothing_of_a_marked_article_is_dropped(inside):
    want = " ".join(re.sub("</?(?:a|mi|mo|mn|math)[^>]*>", "", re.sub("<(?!/?(?:a|mi|mo|mn|math)[ >])[^>]*>", " ", inside)).split())
    page = f"<nav><a href=/>Home</a></nav><article>{inside}</article><div class=related-posts><a href=9>Else</a></div><footer>Foot</footer>"
    assert html_text.main_text(page) == want
    plain = inside.replace("References</h2><ol><li><a href=1>One, a book.</a></li><li><a href=2>Two, a paper.</a></li></ol>", "References</h2>")
    page = f"<nav><a href=/>Home</a></nav><div class=content>{plain}</div><div class=related-posts><a href=9>Else</a></div><footer>Foot</footer>"
    assert html_text.main_text(page) == want.replace(" One, a book. Two, a paper.", "" if plain != inside else " One, a book. Two, a paper.")


@pytest.mark.parametrize("named", ["class=share-bar", "class='social-links'", "id=cookie-notice", "class=related-posts", "class='x ad-box'", "id=comments",
                                   "class=newsletter_signup", "class=main-nav", "class='widget widget_search'", "class=comment-list", "id=sidebar-2"])
def test_named_parts_of_an_article_are_left_out(named):
    assert html_text.main_text(f"<article><p>Text, here, and more.</p><div {named}>No, not this.</div><p>End, here.</p></article>") == "Text, here, and more. End, here."


def test_deep_and_wide_pages_take_linear_time():
    import time
    import tracemalloc
    for page in ("<div>" * 100_000 + "deep", "<div>x, y. " * 50_000, "<div class=ad>x " * 50_000, "<ul>" + "<li><div>x " * 50_000, "<a>x" * 100_000):
        began = time.process_time()
        assert html_text.main_text(page) is not None
        assert time.process_time() - began < 6
    tracemalloc.start()
    html_text.main_text("<div>" * 100_000 + "deep")
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_long_and_broken_pages_end():
    assert html_text.main_text("<div>" * 3000 + "deep" + "<a '" * 50) .startswith("deep")
    assert len(html_text.main_text("<p>" + "word " * 200000)) == 999999


def test_empty_and_repeated_rows_and_other_columns(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == 3 and sorted(r["n_chars"] for r in got)[0] == 0
    assert html_text.extract(pages.limit(0)).count() == 0
