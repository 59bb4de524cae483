import re
import html

from mediarec.llm import queries
from mediarec.llm.common import read
from mediarec.llm.text_density import extracted, main_text


def test_query_matches_the_article(spark, sf):
    """These pages hold their text in one <article>; a plain reading of it gives the blocks."""
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op5_text_density(spark, sf).collect()}
    for r in read(spark, sf, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id] == (r.url, want, len(want))


PARAS = [f"Sentence {i} of the story goes on for quite a while, so that the text is dense enough to stand out." for i in range(6)]


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_surroundings_go():
    article = "".join(f"<p>{p}</p>" for p in PARAS)
    noise = ("<header><h1>Site name</h1></header><div class='top-menu'><a href=1>Home</a> <a href=2>News</a></div>"
             "<div id='cookie-notice'>We use cookies to do things you may like.</div>")
    after = ("<div class=\"comments\"><p>What a fine story, I read all of it and liked it a lot!</p></div><div class=sidebar>Other stories</div>"
             "<form>Your mail <input name=a></form><script>var a='<p>no</p>';</script><footer>Imprint</footer>")
    assert main_text(page(f"{noise}<div class='content'><h2>Head</h2>{article}</div>{after}")) == "\n\n".join(["Head", *PARAS])


def test_text_without_hints_wins_by_density():
    links = "".join(f"<li><a href={i}>Link number {i}</a></li>" for i in range(30))
    article = "".join(f"<p>{p}</p>" for p in PARAS)
    assert main_text(page(f"<div><ul>{links}</ul></div><div>{article}</div>")) == "\n\n".join(PARAS)


def test_nothing_of_an_article_goes():
    """Headings, ids made of headings, tag paragraphs, linked titles and linked paragraphs are text."""
    inner = ("<h1><a href='/self'>A title that links to itself</a></h1><div class='entry-header'>By a writer</div>"
             f"<h2 id='related-work'>Related work</h2><p>{PARAS[0]}</p><section id='search-and-rescue'><h3>Search and rescue</h3><p>{PARAS[1]}</p></section>"
             f"<p class='tags'>Rivers, roads</p><p><a href='x'>{PARAS[2]}</a></p><div class='side-by-side'><p>{PARAS[3]}</p><p>{PARAS[4]}</p></div>"
             "<ol>" + "".join(f"<li><a href='{i}'>A reference with a long title, number {i}, and the place where it came out</a></li>" for i in range(5)) + "</ol>")
    gone = ("<section id='comments'><p>I liked this story a lot, it was a fine one!</p></section><div class='social-share'>Tell others</div><p class='ad'>Buy now.</p>"
            "<div class='related-posts'><p>Another story you may want to read as well</p></div><div class='notice'>This site changes its rules.</div><aside>By the way</aside>")
    want = ["A title that links to itself", "By a writer", "Related work", PARAS[0], "Search and rescue", PARAS[1], "Rivers, roads", PARAS[2], PARAS[3], PARAS[4],
            *[f"A reference with a long title, number {i}, and the place where it came out" for i in range(5)]]
    for around in ("<article>{}</article>", "<main>{}</main>"):
        assert main_text(page(around.format(inner + gone))) == "\n\n".join(want)


def test_lists_of_short_links_go():
    links = "".join(f"<li><a href={i}>Part {i}</a></li>" for i in range(12))
    article = "".join(f"<p>{p}</p>" for p in PARAS)
    assert main_text(page(f"<article>{article}<ul>{links}</ul></article>")) == "\n\n".join(PARAS)


def test_a_very_long_page():
    paras = [f"Paragraph {i} of a very long page has words enough, among them number {i * i}." for i in range(40_000)]
    assert main_text(page("<nav>Menu</nav><article>" + "".join(f"<p>{p}</p>" for p in paras) + "</article>")) == "\n\n".join(paras)


def test_markup_details():
    assert main_text(page("<article><p>One<br>two &lt;b&gt; &amp &#233;<p><b>Three<ul><li>a<li>b</ul></article>")) == "One two <b> & é\n\nThree\n\na\n\nb"
    assert main_text(page("<article><p>a <!-- no --> b</p><p>x < y</p></article>")) == "a b\n\nx < y"
    assert main_text("<p>cut off<a hre") == "cut off"
    deep = "<div>" * 5000 + "text at the bottom" + "</div>" * 5000
    assert main_text(page(deep)) == "text at the bottom"


def test_awkward_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", " \n"), (4, "u", "plain text"), (4, "u", "plain text"), (None, "u", "<p>a</p>"), (5, "u", "<" * 10_000)]
    got = extracted(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got[:6]] == [(1, "", 0), (2, "", 0), (3, "", 0), (4, "plain text", 10), (4, "plain text", 10), (None, "a", 1)]
    assert len(got) == 7
    assert extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
