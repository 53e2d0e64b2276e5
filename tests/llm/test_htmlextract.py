import html as references
import re

import pytest

from foldspark.llm import htmlextract
from tests.conftest import SF_SMALL

PARA = "It was a long and quiet evening when the train finally reached the village by the sea."


def truth(source):
    """Main text of the synthetic pages: what stands in <article>, block by block."""
    inside = re.search(r"<article>(.*)</article>", source or "", re.S)
    if not inside:
        return ""
    blocks = re.split(r"</?(?:p|h1|br|li|ul)>", inside[1])
    clean = (" ".join(references.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def test_synthetic_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    rows = htmlextract.extract(pages).collect()
    assert len(rows) == pages.count()
    assert all(r.text == truth(r.html) for r in rows)


@pytest.mark.parametrize(
    "source,want",
    [
        (f"<p>{PARA}<p>Second &amp;lt; one<br>third", f"{PARA}\nSecond &lt; one\nthird"),
        (f"<body><div class='nav-bar'><a href=/>Home</a></div><div class=content><h2>Head</h2><P>{PARA}</P></div></body>", f"Head\n{PARA}"),
        (f"<main><header><h1>T</h1></header><p>{PARA}</p><aside>side</aside><section id=comments><p>{PARA}</p></section></main>", f"T\n{PARA}"),
        (f"<header>Site</header><article><p>{PARA} <span class='ad'>Buy <b>now</b></span>end</p></article><footer>c</footer>", f"{PARA} end"),
        (f"<article><p>a{PARA}<script>if (a<b) '</p>'</script><style>p>a{{}}</style></p><form><p>mail</p></form></article>", f"a{PARA}"),
        (f"<article><ul><li>one<li>two<ul><li>deep</ul><li>three</ul><p title='a>b'>{PARA}</article>", f"one\ntwo\ndeep\nthree\n{PARA}"),
        (f"<div id=cookie-notice>We use cookies</div><table><tr><td>x<td><p>{PARA}</table>", f"x\n{PARA}"),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("a < b and c > d", "a < b and c > d"),
        ("<p>x&nbsp;&#160; y\n\tz</p><!-- <p>no</p> --><p hidden>no</p>", "x y z"),
        ("<div>" * 3000 + PARA, PARA),
        ("<p>unclosed <b", "unclosed <b"),
        (f"<div class='page has-sidebar'><div class=sidebar-1>links</div><div class=post>{PARA}</div></div>", PARA),
        (f"<div class='widget'><p>{PARA}</p><form>mail</form></div>", PARA),
        (f"<article><p>{PARA}</p><section class='related-work'><p>Others</p></section><div class='alert-levels'>Red</div></article>", f"{PARA}\nOthers\nRed"),
        (f"<article><p>{PARA}</p><div class='related-posts'><p>More</p></div><ul class='share-buttons'><li>X</ul><div id=comments>c</div></article>", PARA),
        (f"<article><figure><label>Figure 1</label> shows</figure><p>where <math><mi>x</mi>=<mn>1</mn></math>. {PARA}</p></article>", f"Figure 1 shows\nwhere x=1. {PARA}"),
        (f"<noscript>Turn scripts on</noscript><article><p>{PARA}</p><noscript><p>Plain table</p></noscript></article>", f"{PARA}\nPlain table"),
        (f"<p><a href=1>One</a> <a href=2>Two</a> | <a href=3>Three</a></p><p>{PARA}<a href=4>a</a><a href=5>b</a><a href=6>c</a></p>", f"{PARA}abc"),
        ("<article><p><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></p></article>", "One Two Three"),
        (f"<article><p>{PARA}</p><form><label>Mail</label><input></form><p class='warning-signs'>Look</p></article>", f"{PARA}\nLook"),
    ],
)
def test_pages(source, want):
    assert htmlextract.main_text(source) == want


def test_consensus(spark):
    """The host's path wins over a page whose own best container is a long box beside the article."""
    page = lambda body, box: (
        f"<body><div class='c1 post-{len(body)}'><p>{body}</p></div><div class='box'><p>{box}</p></div></body>"
    )
    rows = [(i, f"http://H.example:80/{i}", page(PARA * 3, "short")) for i in range(20)]
    rows += [(99, "https://h.example/x", page(PARA * 2, PARA * 3)), (98, None, page(PARA * 2, PARA * 3)), (97, "http://h.example/y", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, winners int")
    got = {r.page_id: r.text for r in htmlextract.extract(df).collect()}
    assert all(got[i].startswith(PARA) for i in range(20))
    assert PARA * 2 in got[99].split("\n") and got[97] == ""
    assert htmlextract.extract(df.limit(0)).count() == 0
    assert htmlextract.extract(df).columns == ["page_id", "url", "html", "winners", "text"]


@pytest.mark.parametrize("times", [3, 12, 35, 120])
def test_lead_beside_content_of_any_length(times):
    """Headline and lead stay however long the article is, also around a box of its own."""
    lead, body = "L" + PARA, PARA * times
    for box in ("<div class=content><p>{}</p></div>", "<div class=wrap><div class=content><p>{}</p></div></div>"):
        page = f"<body><h1>Head</h1><p>{lead}</p>{box.format(body)}<div><a href=/>more and more links</a></div></body>"
        assert htmlextract.main_text(page).startswith(f"Head\n{lead}\n{body}")
        bare = f"<p>{lead}</p>{box.format(body)}"
        assert htmlextract.main_text(bare) == f"{lead}\n{body}"


def test_other_layout_on_a_host(spark):
    """A winning path that holds a part of a page's article does not replace the whole of it."""
    text = lambda x: f"<body><div class=text><p>{x}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", text(PARA * 3)) for i in range(20)]
    rows.append((50, "http://h.example/x", f"<body><div class=text><p>{PARA * 3}</p></div><div class=more><p>{'M' + PARA * 2}</p></div></body>"))
    got = {r.page_id: r.text for r in htmlextract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[50] == f"{PARA * 3}\n{'M' + PARA * 2}"
    assert all(got[i] == PARA * 3 for i in range(20))


def layouts():
    """(name, page from a number, its main text) of hand-made layouts without article or main."""
    para = lambda n, k: f"{PARA} Number {n}, part {k}. " + "More of it. " * (n % 7 + 3 * k)
    clean = lambda *texts: "\n".join(" ".join(t.split()) for t in texts)
    menu = "<nav><a href=/>Home</a> <a href=/n>News</a></nav>"
    links = "".join(f"<a href=/{i}>Some other page {i}</a> " for i in range(12))
    yield "plain boxes", lambda n: (
        f"<body>{menu}<div class='entry e{n}'><h1>Head {n}</h1><p>{para(n, 1)}</p><p>{para(n, 2)}</p></div><div class=footer>(c) us</div></body>",
        clean(f"Head {n}", para(n, 1), para(n, 2)),
    )
    yield "two boxes", lambda n: (
        f"<body><div id=top class=navbar>{links}</div><div class=left><p>{para(n, 3)}</p></div><div class=right><p>{para(n, 1)}</p></div></body>",
        clean(para(n, 3), para(n, 1)),
    )
    yield "table", lambda n: (
        f"<table><tr><td class=menu>{links}<td class=text><b>Head {n}</b><br>{para(n, 1)}<br><br>{para(n, 2)}<tr><td colspan=2>{links}</table>",
        clean(f"Head {n}", para(n, 1), para(n, 2)),
    )
    yield "bare", lambda n: (f"<html><body><h1>H{n}</h1>{para(n, 1)}<p>{para(n, 2)}<ul><li>one<li>two</ul>", clean(f"H{n}", para(n, 1), para(n, 2), "one", "two"))
    yield "old header", lambda n: (
        f"<center><div class=site-header>The Site</div></center><div class=c{n}><p>{para(n, 2)}</p><div class='comments-area'><p>{para(n, 1)}</p></div></div>",
        clean(para(n, 2)),
    )
    yield "role", lambda n: (
        f"<div role=banner>Site</div><div role=main><p>{para(n, 1)}</p><div role=complementary>side</div></div><div role=contentinfo>end</div>",
        clean(para(n, 1)),
    )
    yield "cookie", lambda n: (
        f"<div class=cookie-consent><p>We use cookies. {PARA}</p></div><div class=post-body><p>{para(n, 1)}</p><aside>See also</aside></div>",
        clean(para(n, 1)),
    )


@pytest.mark.parametrize("name,page", list(layouts()))
def test_layouts(spark, name, page):
    """One host a layout, and one host where pages of every layout mix: nothing of an article is lost."""
    rows, want = [], {}
    for n in range(25):
        source, text = page(n)
        want[n] = text
        rows.append((n, f"http://{name.replace(' ', '')}.example/{n}", source))
    for k, (_, other) in enumerate(layouts()):
        for n in range(3):
            source, text = other(n)
            want[1000 + 10 * k + n] = text
            rows.append((1000 + 10 * k + n, f"http://{name.replace(' ', '')}.example/m/{k}/{n}", source))
    got = {r.page_id: r.text for r in htmlextract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
