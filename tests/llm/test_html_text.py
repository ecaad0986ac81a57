import html
import random
import re
import time

import pytest

from idlattice.llm import html_text as H

LONG = "This is the text of the article and it is long enough to be decided by the rules of the first pass."
CASES = [
    ("", ""),
    ("plain text only", ""),
    ("<article>Tiny</article>", "Tiny"),
    ("<article>&am<b>p;</b> &amp;</article>", "&amp; &"),
    (f"<article><h1>Head &amp; tail</h1><p>{LONG}<p>a<b>b</b>c<br>d&nbsp;e</article>", f"Head & tail {LONG} abc d e"),
    (f"<nav><a href=/>Home</a></nav><header><h1>Site</h1></header><main><p>{LONG}</p></main><footer>Of the end</footer>", LONG),
    (f'<div class="cookie-notice">We use cookies and that is good for all of you and for the others.</div><div id=content><h2>Title</h2><p>{LONG}</p><p>End.</p></div><div class="comments"><p>I like the article and it was the best of all that I have read so far.</p></div>', f"Title {LONG} End."),
    (f"<article><p>{LONG}</p><section class='comments'><p>{LONG} No.</p></section><aside>{LONG}</aside><form><label>Name</label></form></article>", LONG),
    (f"<script>if (a<b) x('</p>')</script><style>p{{}}</style><article><p>{LONG}<script>y</script> tail</p></article>", f"{LONG} tail"),
    ("<article>5 &lt; 6 < 7 &amp;amp; &#233;&#x41;</article>", "5 < 6 < 7 &amp; éA"),
    ("<ARTICLE CLASS=x><P>Up <!-- <p>no</p> --> per</ARTICLE>", "Up per"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>three<td>four</table></article>", "one two three four"),
    ("<article><div hidden>no</div><div style='display: none'>no</div><p>yes</p></article>", "yes"),
    ("<article>open <b>never closed <a href='x", "open never closed <a href='x"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_main_text(page, text):
    assert H.main_text(page) == text


def test_pages_of_the_tables(spark):
    """These pages have one article element, whose blocks are all of the article."""
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = H.op3_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[a-zA-Z/][^>]*>", "", re.sub("<br>|</?(?:p|h1)>", " ", inner))).split())
        assert r.n_chars == len(r.text)


def truth(page):
    inner = re.search("<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub("<[a-zA-Z/][^>]*>", "", re.sub("<br>|</?(?:p|h1)>", " ", inner))).split())


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]


def test_without_article_elements(pages):
    """Density, length and links find the text where no element names it."""
    same = [H.main_text(re.sub(r"<(/?)article", r"<\1div", p)) == truth(p) for p in pages]
    assert sum(same) / len(same) > 0.98


def bare(page):
    return re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|nav|header|footer|aside|section|main|form)\b", r"<\1div", page))


def test_each_rule_decides_on_bare_pages(pages, monkeypatch):
    """With all of those elements renamed and no classes, each test changes results, and the text is still found."""
    plain = [H.main_text(bare(p)) for p in pages]
    found = [truth(p) in t and len(t) <= len(truth(p)) + 300 for p, t in zip(pages, plain, strict=True) if len(truth(p)) > 300]
    assert sum(found) / len(found) > 0.8  # adverts without a class are the rest
    for name, off in (("STOP_SHARE", 0.0), ("LINK_SHARE", 2.0), ("LONG", 1)):
        monkeypatch.setattr(H, name, off)
        assert sum(H.main_text(bare(p)) != t for p, t in zip(pages, plain, strict=True)) >= 3
        monkeypatch.undo()


def test_density_decides_between_divs():
    link = "<a href=x>one of the links that is in the menu of the site</a> "
    table = "<td>4711 ml ABC-12</td>" * 30
    p = f"<div>{link * 4}</div><div><h2>Title</h2><p>{LONG}</p><table><tr>{table}</tr></table><p>{LONG}</p></div><div>{link * 4}</div><div>© The owner</div>"
    assert H.main_text(p) == f"Title {LONG} {' '.join(['4711 ml ABC-12'] * 30)} {LONG}"


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '>", "<b>", "<b></i>", "<!", "<!--", "</script ", "<script>", "<p>", "<b><p>", "<div>x", "<li>", "<td><table>"])
def test_malformed_pages_take_linear_time(piece):
    begin = time.perf_counter()
    H.main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - begin < 15  # quadratic scans take minutes


@pytest.mark.parametrize("piece", ["\"<a '>'\" ", "<a \"'>\" '", "<b x='\">'\"", "' <i \" > '\" "])
def test_quotes_without_an_end_take_linear_time(piece):
    """Quotes that are left open whichever way they are paired."""
    for tail in ('"', "'", "\"'"):
        page = "<p>x</p><a " + piece * (1_000_000 // len(piece)) + tail
        begin = time.perf_counter()
        H.main_text(page)
        assert time.perf_counter() - begin < 8


def test_quotes_and_ends_of_tags():
    """Every start in small pages gives what a scan without memory gives."""

    def plain(html, at):
        place = at
        while m := H.QUOTE_OR_END.search(html, place):
            if m[0] == ">":
                return m.end()
            if (close := html.find(m[0], m.end())) < 0:
                break
            place = close + 1
        return html.find(">", at) + 1 or -1

    rng = random.Random(7)
    for _ in range(500):
        html, hopeless = "".join(rng.choices("a>'\"", weights=[3, 1, 2, 2], k=30)), set()
        for at in range(len(html)):
            assert H.end_of_tag(html, at, hopeless) == plain(html, at)


def test_edges_of_the_input(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<article>" + "word " * 300_000 + "</article>"), (3, "u", "<p>" * 20_000), (None, "v", "<article>a</article>")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.n_chars) for r in H.extract(pages).collect()), key=str)
    assert got == sorted([(1, 0), (2, 0), (3, 1_499_999), (3, 0), (None, 1)], key=str)
    assert H.extract(pages.limit(0)).count() == 0
