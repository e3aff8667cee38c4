"""Main text of pages written out by hand, and of the driver's pages."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vectext.llm import html_text

PAGES = [
    (None, ""), ("", ""), ("  \n ", ""), ("<html><body></body></html>", ""), ("plain text", "plain text"),
    ("<p>a &lt; b &amp;amp; c&#33; &eacute;</p>", "a < b &amp; c! é"),
    ("<p>one<br>two  three\n\tfour</p><div>five</div>", "one two three four\nfive"),
    ("<p>a <b>bold</b> <i>word</i>s</p>", "a bold words"),
    ("<p title='a > b'>ok</p><p title=\"it's\">fine</p>", "ok\nfine"),
    ("<script>var a = '<p>x</p>'</script><style>p{}</style><p>text</p>", "text"),
    ("<p>text</p><script>never closed <p>x</p>", "text"), ("<p>text</p><!-- never closed <p>x</p>", "text"),
    ("<!-- <p>x</p> --><p>text</p>", "text"), ("<p>1 < 2</p>", "1 < 2"), ("<p>open <p>next", "open\nnext"),
    ("<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>T</h1><p>Be.</p></article><footer>rights</footer>", "T\nBe."),
    ("<header><p>Site name and a long line about what it is</p></header><article><header><h1>T</h1></header><p>b</p></article>", "T\nb"),
    ("<article><p>t</p><div class='reader-comments'><p>I do not agree with any of this at all</p></div><p>u</p></article>", "t\nu"),
    ("<article><p>t</p><aside><p>about the author of this text</p></aside><form><label>Name</label></form></article>", "t"),
    ("<div id=cookieNotice><p>We use cookies on all of these pages here.</p></div><p>text of the page</p>", "text of the page"),
    ("<div class='ad'>Buy now.</div><article><p>See <a href=1>this</a> there.</p></article>", "See this there."),
    ("<ARTICLE><P>upper</P></ARTICLE><FOOTER>no</FOOTER>", "upper"),
    ("<div class='header-image'><p>adds are not ads</p></div>", "adds are not ads"),
    ("</div></p><p>stray ends</p></article>", "stray ends"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_pages(page, text):
    assert html_text.main_text(page) == text


BODY = "<h1>T</h1><p>The first sentence of a text that is long enough to be one.</p><p>Short.</p>"
TEXT = "T\nThe first sentence of a text that is long enough to be one.\nShort."
SIDE = "<div class='sidebar'><p>Some words beside the text.</p></div>"
NAMES = ["content with-sidebar", "has-comments", "share-ready", "post-with-ads", "no-sidebar"]
WRAPPED = [
    *[(f"<div class='{name}'><article>{BODY}{SIDE}</article>{SIDE}</div>{SIDE}", TEXT) for name in NAMES],
    *[(f"<article class='{name}'>{BODY}{SIDE}</article>", TEXT) for name in NAMES],
    *[(f"<main><div id='{name}'>{BODY}{SIDE}</div></main>", TEXT) for name in NAMES],
    (f"<div class='{NAMES[0]}'><article><p>a</p></article></div><div class='{NAMES[2]}'><article><p>b</p></article></div>", "a\nb"),
    (f"<form id='aspnetForm'><nav><a>Home</a></nav>{BODY}{SIDE}<footer>end</footer></form>", TEXT),
    (f"<form><article>{BODY}<form class='search'><p>Search all of the many texts here</p></form></article></form>", TEXT),
    (f"<div class='sidebar'><article>{BODY}</article></div>", TEXT),
    # What the marks are for stays out.
    (f"<article>{SIDE}</article>", ""), (f"<div style='display:none'><article>{BODY}</article></div>", ""),
    (f"<article><p>a b c d e f g h i j k l m n o p q</p></article><aside><article>{BODY}</article></aside>", "a b c d e f g h i j k l m n o p q"),
    (f"<article>{BODY}</article><div class='comment-list'><article><p>{'words ' * 9}</p></article></div>", TEXT),
    (f"<p>{'word ' * 30}</p><form><p>Tell us in a few words what you think of this</p></form>", "word " * 29 + "word"),
    # Neighbours decide on blocks without a mark.
    (f"<div><a>Home</a></div><div>You are here</div><div><a>News</a></div>{BODY}", TEXT),
    (f"<div><a>Home</a></div><article><p>Short.</p></article><div><a>News</a></div>", "Short."),
]


@pytest.mark.parametrize("page, text", WRAPPED)
def test_wrappers_of_main_text(page, text):
    assert html_text.main_text(page) == text


def test_deep_marks():
    assert html_text.main_text("<div class=ad>" * 20_000 + "<p>no</p>") == ""


def test_tree_learns_its_table():
    x, y = html_text.labelled_table(html_text.EXAMPLES)
    assert len(y) > 90 and ((html_text.trained_tree().shares(x) > 0.5) == y.astype(bool)).all()
    assert html_text.features([]).shape == (0, len(html_text.FEATURES))


def test_features_look_at_neighbours():
    blocks = html_text.Page("<p>one two</p><p><a>link</a></p><p>three</p>").blocks
    table = html_text.features(blocks)
    assert table[:, 0].tolist() == [2, 1, 1] and table[:, 1].tolist() == [0, 1, 0]
    assert table[1, 2:6].tolist() == [2, 0, 1, 0] and table[0, 4:6].tolist() == [1, 1]


def test_long_page():
    body = "".join(f"<p>sentence {k} of many</p>" for k in range(50_000))
    assert html_text.main_text(f"<article>{body}</article>").count("\n") == 49_999
    assert html_text.main_text("<" * 100_000) == "<" * 100_000


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("n", F.lit("kept"))
    got = html_text.extract_text(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h\d|div|li|ul)[^>]*>", article.replace("<br>", " "))
        texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
        assert r["text"] == "\n".join(t for t in texts if t)
    none = pages.where(F.lit(False))
    assert html_text.extract_text(none).count() == 0


@pytest.mark.parametrize("piece", [
    "<a b ", "<a b='", "<a b=\"", "<a \" > \" ", "<a ' > \" ", "<a '\">", "<!x ", "<?", "<!--", "<script>", "</script ", "<div>", "</div>",
    "<p>", "<a href=x>", "<div></p>", "<div></section>", "<", "<<a", "<a =\"'\" ", "<x>'", "<x y=\"'>",
])
@pytest.mark.parametrize("end", ["", ">", "'>"])
def test_hostile_pages_take_linear_time(piece, end):
    """What took hours took time that grows with the square of the length."""
    source = piece * (2_000_000 // len(piece)) + end
    reader = html_text.Tags(source)
    start, at = time.process_time(), 0
    while (opening := source.find("<", at)) >= 0:
        tag = html_text.TAG_NAME.match(source, opening)
        found = reader.end(tag.end()) if tag else reader.next(">", opening) + 1
        at = found if found > opening else opening + 1
    assert time.process_time() - start < 5
    page = piece * (200_000 // len(piece)) + end
    start = time.process_time()
    html_text.Page(page)
    assert time.process_time() - start < 8


OLD_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/><'\"]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/><'\"]*)([^>]*)>"
)


def test_tags_end_as_one_pattern_says():
    rnd = random.Random(1)
    for _ in range(4000):
        source = "".join(rnd.choices(["<a", "<b ", "</a", ">", "'", '"', " x", "=", "\n", "/"], k=rnd.randint(1, 30)))
        reader, at = html_text.Tags(source), 0
        while (opening := source.find("<", at)) >= 0:
            tag, want = html_text.TAG_NAME.match(source, opening), OLD_TAG.match(source, opening)
            end = reader.end(tag.end()) if tag else -1
            assert end == (want.end() if want else -1), source
            at = end if end > 0 else opening + 1


@pytest.mark.parametrize("page, text", [
    ("<p><a name='top'>Here begins the text.</p><p>And here it goes on for a while.</p>", "Here begins the text.\nAnd here it goes on for a while."),
    ("<a id=top><h1>T</h1><p>It begins here.</p>", "T\nIt begins here."),
    ("<div><p><a href=x>Unclosed</p><p>The text goes on for quite a while here.</p></div>", "The text goes on for quite a while here."),
    ("<ul><li><a href=x>Home</ul><p>The text goes on for quite a while here.</p>", "The text goes on for quite a while here."),
    ("<article><p>With <math><mi>x</mi></math>, <noscript>no script</noscript> and <object>a thing</object>.</p></article>", "With x, no script and a thing."),
    ("<script src='x'/>var a = 1;</script><p>text</p>", "text"), ("<p>a</p><svg/><p>b</p>", "a\nb"),
])
def test_links_and_raw_elements(page, text):
    assert html_text.main_text(page) == text
