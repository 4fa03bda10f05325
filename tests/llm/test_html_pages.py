"""Pages that tempt an extractor to lose text, each against the text that it should give."""

import time

import pytest

from stowage.llm import html_extract

ARTICLE = "<html><body><nav>menu</nav><article><h1>Head</h1>{}<p>The last paragraph.</p></article><footer>foot</footer></body></html>"
CASES = [
    ("<p title='it's'>One.</p><p>It's two.</p>", "One.\nIt's two."),
    ("<p data-x=it's>One.</p><p>Two, isn't it?</p>", "One.\nTwo, isn't it?"),
    ('<p title="open>One.</p><p>Two.</p>', "One.\nTwo."),
    ("<p it's>One.</p><p a='b'c=\"d>e\">Two.</p>", "One.\nTwo."),
    ('<p title=a="b>One.</p><p>"Two".</p>', 'One.\n"Two".'),
    ('<p title="a > b">One.</p>', "One."),
    ('<section class="related-work"><p>Section.</p></section><div class="share-price">42 euro</div>', "Section.\n42 euro"),
    ('<div class="header-image-text">Kept.</div><div class="ad">bought</div><div id="ad-7">more</div>', "Kept."),
    ('<div class="share">on a site</div><aside>side</aside><form>ask</form><p>Kept.</p>', "Kept."),
    ('<div class="comments"><article class="comment"><p>a reader</p></article></div><article class="comment">b</article><p>Kept.</p>', "Kept."),
    ("<!--> <p>One.</p> <!-- gone --!><p>Two.</p><!doctype x>", "One.\nTwo."),
    ("</><p>1 < 2 and 3 </ 4>.</p><![CDATA[data]]>", "1 < 2 and 3 .\ndata"),
    ("<script>if (a</scripty) x</script ><p>One.</p>", "One."),
    ("<p>a<b>b</i>c</b>d<p>e<table><tr><td>f<td>g<tr><td>h</table>i", "abcd\ne\nf\ng\nh\ni"),
]


@pytest.mark.parametrize("inner, want", CASES)
def test_no_text_is_lost(inner, want):
    page = html_extract.parse(ARTICLE.format(inner))
    assert html_extract.extract(page, None) == f"Head\n{want}\nThe last paragraph."


@pytest.mark.parametrize("tag", ["div", "div class='a b1'", "span", "b"])
def test_deep_nesting_is_linear(tag):
    """Many thousand nested elements; text at the bottom stays."""
    import tracemalloc

    n = 300_000 // (2 * len(tag))
    source = "<article><p>Top.</p>" + f"<{tag}>" * n + "<p>Bottom.</p>" + f"</{tag.split()[0]}>" * n + "<p>End.</p></article>"
    tracemalloc.start()
    began = time.time()
    page = html_extract.parse(source)
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert html_extract.extract(page, None) in ("Top.\nBottom.\nEnd.", "Bottom.")
    assert "\n".join(page.blocks) == "Top.\nBottom.\nEnd." and took < 30 and peak < 150 << 20


def test_long_articles_vote_by_their_length(spark):
    """A text of over 10,000 characters outvotes a shorter one; columns with clashing names are left alone."""
    long, short = "<p>" + "long words here " * 2000 + "</p>", "<p>" + "short words here " * 900 + "</p>"
    body = lambda first, second: f"<body><div class='x1'>{first}</div><div class='y2'>{second}</div></body>"
    rows = [(1, "http://h/a", body(long, "<p>a</p>"), "h", "p", 1.0, "t"), (2, "http://h/b", body("<p>b</p>", short), "h", "p", 2.0, "t"), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, score double, text string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert got[None] == "" and got[1].startswith("long words") and got[2] == "b"


def text_of(page):
    return html_extract.extract(html_extract.parse(page), None)


@pytest.mark.parametrize("form", ["<form>", '<form id="aspnetForm" action="/x">'])
def test_a_form_that_frames_the_page(form):
    page = f"<body>{form}<div class='nav'>Menu</div><article><p>{'An article of some length. ' * 5}</p><form><label>Name</label>Send <input></form></article><label>Mail</label></form></body>"
    assert text_of(page) == ("An article of some length. " * 5).strip()


def test_small_forms_stay_boilerplate():
    assert text_of("<body><article><p>" + "One sentence more. " * 9 + "</p></article><form>Subscribe to our letters</form></body>") == ("One sentence more. " * 9).strip()


def test_whole_tokens_mark_boilerplate_outside_articles_too():
    kept = [f'<div class="{c}"><p>The {c} part has text of its own.</p></div>' for c in ("related-work", "share-price", "notice-board", "header-image", "ad-hoc", "comment_ary")]
    gone = [f'<div class="{c}"><p>Gone.</p></div>' for c in ("related", "share-buttons", "notice", "header", "ad", "comments", "sidebar2")]
    assert text_of('<div class="content">' + "".join(a + b for a, b in zip(kept, gone + gone)) + "</div>").count("\n") == len(kept) - 1


@pytest.mark.parametrize("piece", ["<![CDATA[ x ", "<![CDATA[ x>", "<!-- x", "<!-- x>", "<form>x", "<form><p>x</form>", '<a b="', "</"])
def test_time_is_in_proportion(piece):
    began = time.time()
    html_extract.parse("<div>" + piece * (2_000_000 // len(piece)))
    assert time.time() - began < 20
