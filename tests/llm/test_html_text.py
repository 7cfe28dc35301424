"""Main text of pages of many shapes."""

import pytest

from heatloom.llm.html_text import extract, main_text
from tests.llm.cases import FOLDER

P1 = "A first paragraph of the article, long enough to count; it goes on for a while, as paragraphs do."
P2 = "The second one says more, and more than that: all of it belongs to the text."
NAV = '<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">All of the news</a></li></ul></nav>'
FOOT = "<footer>&copy; somebody &middot; a long line of legal words, which nobody reads, in the footer of it all.</footer>"
PARTS = [f"Paragraph {i} of the story, which is long: {P1}" for i in range(40)]
STORY, LONG_STORY = "".join(f"<p>{x}</p>" for x in PARTS), "\n".join(PARTS)
CASES = {
    "plain": (f"<html><body>{NAV}<article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article>{FOOT}</body></html>", f"Title\n{P1}\n{P2}"),
    "unclosed": (f"<body>{NAV}<div class='ad'>Buy this, and that, and much more, now!</div><article><h1>Title</h1><p><b>{P1}<br><p>{P2}<p>To.</article>{FOOT}", f"Title\n{P1}\n{P2}\nTo."),
    "cut off": (f"<html><body>{NAV}<article><h1>Title</h1><p>{P1}<p>{P2}", f"Title\n{P1}\n{P2}"),
    "one paragraph": (f"<body>{NAV}<article><h1>T</h1><p>{P1}</p></article>{FOOT}", f"T\n{P1}"),
    "script": (f'<head><style>p{{a:b}}</style><script>var t="</p><p>no</p>";</script></head><article><p>{P1}</p><SCRIPT>x<y</SCRIPT><p>{P2}</p></article>', f"{P1}\n{P2}"),
    "comments": (
        f"<body><header>My site, with a slogan</header><main><article><h2>T</h2><p>{P1}</p><p>{P2}</p></article>"
        f"<section class='comments'><p>I read it all, and I think: it was good, very good!</p><p>So did I, yes.</p></section></main></body>",
        f"T\n{P1}\n{P2}",
    ),
    "inner parts": (
        f"<article><p>{P1}</p><aside>By the way, something else entirely.</aside><div class='ad-box'>Buy.</div><form>Name <input> ok</form>"
        f"<div id=cookie-notice>We use cookies, and so on.</div><p>{P2}</p><div class='share-buttons'>Share</div></article>",
        f"{P1}\n{P2}",
    ),
    "divisions": (
        f"<div id=top><a href=1>One</a> <a href=2>Two</a></div><div id=content><h1>T</h1><p>{P1}</p><p>{P2}</p></div>"
        f"<div class=sidebar><p>Old things, in a list, of some length, for you.</p></div><div class=footer><p>{P1}</p></div>",
        f"T\n{P1}\n{P2}",
    ),
    "space and signs": ("<article><p>  a&amp;b\n\t c&eacute; &#x1F642;&lt;x&gt;  <i>d</i>e </p><p> </p><p>2 < 3 &bogus; x</p></article>", "a&b cé 🙂<x> de\n2 < 3 &bogus; x"),
    "no tags": (" just \n text ", "just text"),
    "comment mark": (f"<article><!-- <p>no</p> --><p>{P1}</p><!-- open <p>{P2}</p></article>", P1),
    "quotes": (f"<article><p title='a > b' data-x=\"1>2\">{P1}</p><p title=don't>{P2}</p></article>", f"{P1}\n{P2}"),
    "upper case": (f"<BODY><NAV>Menu, menu</NAV><ARTICLE><P>{P1}</P></ARTICLE></BODY>", P1),
    "around the story": (
        f"<body><div id=top><a href=1>One</a> <a href=2>Two</a></div><div id=content><h1>T</h1><p>{P2}</p><div class=story>{STORY}</div><p>The end.</p></div></body>",
        f"T\n{P2}\n{LONG_STORY}\nThe end.",
    ),
    "in the body": (f"<body><h1>T</h1><p>{P2}</p><div class=story>{STORY}</div><p>The end.</p>{FOOT}</body>", f"T\n{P2}\n{LONG_STORY}\nThe end."),
    "name of content": (f"<body>{NAV}<div class=legal-history><h1>T</h1>{STORY}</div>{FOOT}</body>", f"T\n{LONG_STORY}"),
    "much in a side name": (f"<body>{NAV}<div class=widget><h1>T</h1>{STORY}</div>{FOOT}</body>", f"T\n{LONG_STORY}"),
    "several articles": (f"<main><article><h2>A</h2><p>{P1}</p></article><article><h2>B</h2>{STORY}</article></main>", f"A\n{P1}\nB\n{LONG_STORY}"),
    "soft name inside": (
        f"<article>{STORY}<div class='social-science'><p>{P1}</p></div><div class='social-links'>Follow us</div><p>{P2}</p></article>",
        f"{LONG_STORY}\n{P1}\n{P2}",
    ),
    "short article": (f"<body><div class=ad>{P1}</div><article><h1>T</h1><p>So.</p></article>{FOOT}</body>", "T\nSo."),
    "middle of a name": (f"<article><p>{P1}</p><div class='my-ad-free-story'><p>{P2}</p></div></article>", f"{P1}\n{P2}"),
    "more comments than text": (f"<body><div><h1>T</h1><p>{P1}</p></div><div id=comments>{STORY}</div></body>", f"T\n{P1}"),
    "menu without a name": (f"<div><ul><li><a href=1>{P2}</a><li><a href=2>{P1}</a></ul><p>{P1}</p>{STORY}</div>", f"{P1}\n{LONG_STORY}"),
    "null": (None, ""),
    "empty": ("", ""),
    "no text": ("<html><body><nav>Menu</nav><p> </p></body></html>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    source, want = CASES[name]
    assert main_text(source) == want


def test_deep_long_and_broken():
    assert main_text("<div>" * 20_000 + P1).endswith(P1)
    assert main_text("<article><p>" + "word " * 200_000).count("word") == 200_000
    for source in ("<", "<p", "</", "<a href='", "<!", "<!--", "<p><b></p></b></i>x", "<li>" * 5000 + "x", "&#xD800;&#0;<p>x", "<table><tr><td>a<tr><td>b</table>", "='" * 3000):
        assert isinstance(main_text(source), str)


def test_pages(spark):
    """The articles of the given pages, cut out by their marks."""
    import html
    import re

    rows = extract(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    assert len(rows) == len(sources)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", sources[r.page_id], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inside)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_edge_rows(spark):
    rows = [(1, None, None, "c", 1, "x"), (1, "u", P1, "c", 2, "x"), (None, "u", "", "c", 3, "x"), (1, "u", P1, "c", 4, None)]
    df = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, lang string"))
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted([(1, None, "", 0), (1, "u", P1, len(P1)), (None, "u", "", 0), (1, "u", P1, len(P1))], key=repr)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
