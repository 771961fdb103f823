import html
import re
import time

import duckdb

from seasonwin.llm.html_text import Rules, extract, main_text

SENTENCE = "The keeper of the light was on the hill and he wrote down what the ships had done in the night. "
LONG, MIDDLE = SENTENCE * 3, SENTENCE


def page(body, head="<title>Not this</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_given_pages():
    """On the given pages the article is what stands in its element, a block for each heading and paragraph."""
    rows = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (text,) in rows:
        inside = re.search(r"<article>(.*?)</article>", text, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert main_text(text) == "\n\n".join(b for b in blocks if b)


def test_parts_around_an_article_go():
    got = main_text(page(f"""
      <header class="site"><h1>Site</h1><p>{LONG}</p></header><nav><a href=/>Home</a> <a href=/b>More</a></nav>
      <div class="cookie-notice"><p>{LONG}</p></div><main><header><h1>Ti&amp;tle &eacute;&#233;&#xe9;</h1></header>
      <p>{LONG}</p><div class="ad">{LONG}</div><p>Short.</p><script>if (a < b) {{ "<p>" }}</script><style>p{{}}</style>
      <blockquote>Said <b>so</b>me<a href=x>one</a>.<br>Twice.</blockquote><aside>{LONG}</aside><form><p>{LONG}</p><label>Name</label></form>
      <ul><li>One</li><li>Two</ul><p hidden>{LONG}</p><p>An <span class="ad">advert</span> inside<button>Click</button></p></main>
      <section id="comments"><article class="comment"><p>{LONG}</p></article></section><div id="sidebar">{LONG}</div><footer>{LONG}</footer>"""))
    assert got.split("\n\n") == ["Ti&tle ééé", LONG.strip(), "Short.", "Said someone. Twice.", "One", "Two", "An inside"]


def test_rules_where_no_element_marks_the_article():
    got = main_text(page(f"""
      <div><ul><li><a href=1>The news of the day and of the week and all that is in it</a><li><a href=2>All of the rest that was on</a></ul></div>
      <div class="wrap"><h2>Heading of it</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><p>No.</p></div>
      <p>{'Imprint Contact Jobs Terms Press Login ' * 8}</p><p>Rights</p><p>&copy; 2024 by the paper</p>"""))
    assert got.split("\n\n") == ["Heading of it", LONG.strip(), "Yes.", LONG.strip(), "No."]


def test_content_named_by_a_class():
    got = main_text(page(f'<div class="teaser"><p>{LONG}</p></div><div class="post-content"><p>Qx zz.</p><p>{MIDDLE}</p></div><div class="post-comments"><p>{LONG}</p></div>'))
    assert got == f"Qx zz.\n\n{MIDDLE.strip()}"


def test_short_blocks_inherit_from_the_nearest():
    links = "<li><a href=x>link of the day</a></li>" * 3
    got = main_text(f"<ul>{links}</ul><p>Near links.</p><p>In between.</p><p>Near text.</p><p>{LONG}</p>")
    assert got == f"In between.\n\nNear text.\n\n{LONG.strip()}"
    assert main_text("<p>Only this.</p>") == "Only this."
    assert main_text(f"<p>{MIDDLE}</p>", Rules(short=10_000)) == MIDDLE.strip()


def test_broken_markup_ends():
    assert main_text("<head><title>t<p>x") == "" and main_text("<head><meta charset=x><p>x") == "x"
    assert main_text("a < b &lt; c <") == "a < b < c <" and main_text("<p>x <!-- y") == "x" and main_text("x<b") == "x"
    assert main_text("<p title='a>b'>x</p><p title='>y</p>") == "x\n\ny"
    began = time.time()
    for text in ("<div>" * 50_000 + "</span>" * 50_000, "<a t='" * 50_000, "<!--" * 50_000, "<" * 50_000, "<p>x " * 50_000, "<script>" * 50_000, "<p title='>" * 50_000):
        main_text(text)
    assert time.time() - began < 20


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, n int"
    rows = [(1, "u", None, "t", "c", 1), (1, "u", None, "t", "c", 1), (None, None, "", "t", "c", 1), (2, "v", f"<p>{'the é of ' * 100_000}</p>", "t", "c", 1), (3, "w", "<p>  a   b\n</p>", "t", "c", 1)]
    got = extract(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(map(tuple, got.collect()), key=repr)
    long = ("the é of " * 100_000).strip()
    assert found == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "", 0), (2, "v", long, len(long)), (3, "w", "a b", 3)], key=repr)
    assert extract(spark.createDataFrame([], schema)).count() == 0
