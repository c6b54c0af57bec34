import html
import json
import random
import re

import pytest

from heddle.llm import extraction as x
from heddle.llm import queries
from heddle.llm.scratch import Scratch

DATA = "/root/testdata/sf0.001"


def text(page, *others):
    streams = [x.fold([(t, False, False) for t, _ in x.stream(p)]) for p in (page, *others)]
    return x.text_of(page, x.roles(x.infer(streams)))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a<p>b", "a\nb"),
        ("<p>a <b>b</b>\n c<br>d</p>", "a b c d"),
        ("<article><h1>T</h1><p>x</article><p>outside", "T\nx"),
        ("<header>h</header><nav>n</nav><p>a</p><aside>s</aside><footer>f</footer>", "a"),
        ("<article><header><h1>T</h1>by me</header><p>x</p><footer>f</footer></article>", "T\nx"),
        ('<main><p>x</p><div class="comments"><p>c</p></div><section id="related-posts"><p>r</section></main>', "x"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><p>x<!-- <p>c --></p><form><p>f</form>", "x"),
        ('<p>a</p><div class="cookie-notice">c</div><div role=alert>d</div><div hidden>e</div><p style="display: none">f</p>', "a\nf"),
        ("<title>t</title><p>&lt;p&gt; &#233;&nbsp;&nbsp;x &unknown; &amp;amp;</p>", "<p> é x &unknown; &amp;"),
        ("<div class='download'>kept</div><div class='ads'>no</div>", "kept"),
        ("<p>a < b and c<d e", "a < b and c"),
        ("<ul><li>a</li><li>b<ul><li>c</ul></ul><table><tr><td>1<td>2</table>", "a\nb\nc\n1\n2"),
        ("<div>a<div>b</div>c</div></div></p><p>d", "a\nb\nc\nd"),
        ("<script>never closed <p>x", ""),
        ("<html><head><meta charset=x><title>t</title><body><p>hello", "hello"),
        ("<head><title>t</title>hello<p>you", "hello\nyou"),
        ('<body class="post has-sidebar"><p>x</body>', "x"),
        ('<div class="page-with-header"><main><p>x</main></div>', "x"),
        ('<article><p>a</p><section class="search-engines"><p>b</p></section></article>', "a\nb"),
        ('<article><p>a<p class="advertisement">no<p>b</article>', "a\nb"),
        ("<table><tr><td class=sidebar><div>no</div><p>no<td>b<tr><td>c</table>", "b\nc"),
        ('<ul><li class="ad">no<ul><li>no</ul><li>b</ul>', "b"),
        ('<p>a <span class="ad">no <b>no</b></span>b <span class=word>c</span></p>', "a b c"),
        ('<pre><code>x <span class="ad">y</span></code></pre>', "x y"),
    ],
)
def test_pages(page, want):
    assert text(page) == want


def test_fold():
    items = [(t, False, False) for t in "a b b c d c d c d e".split()]
    assert [x._shown(i) for i in x.fold(items)] == ["a", "b+", "(c d)+", "e"]
    nested = [(t, False, False) for t in "r p p /r r p /r r p p p /r".split()]
    assert [x._shown(i) for i in x.fold([*nested])][-1].endswith("+")


def test_wrapper_of_two_pages():
    a, b = (x.fold([(t, False, False) for t in s.split()]) for s in ("h a b n p p p f", "h a c p f g"))
    assert [x._shown(i) for i in x.infer([a, b])] == ["h", "a", "b?", "n?", "c?", "p+", "f", "g?"]


def test_other_pages_of_the_host_tell_where_the_article_is():
    page, other = "<div><p>a</div>", "<div><p>b</div><article><p>c</article>"
    assert text(page, other) == "a" and text(other, page) == "c"


def test_frames(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(9, "http://l.x", f"<article>{long}</article>"), (1, "http://H.x/1", "<article>a</article>"), (1, "http://h.x:80/2", "<article>a</article>"), (2, None, "<p>b"), (3, "nonsense", None), (4, "https://u@h.x", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, wrapper int").withColumn("host", x.host()).withColumn("fixed", x.F.lit(1))
    assert sorted(r["host"] for r in df.collect()) == ["", "", "h.x", "h.x", "h.x", "l.x"]
    found = x.wrappers(df, Scratch(spark, "t"))
    got = sorted(map(tuple, x.extract(df, found, ["page_id"]).collect()))
    assert got == [(1, "a"), (1, "a"), (2, "b"), (3, ""), (4, ""), (9, long)]
    assert sorted(map(tuple, x.extract(df, found, ["page_id", "wrapper"]).select("page_id", "wrapper").collect())) == [(r[0], 1) for r in sorted(rows, key=lambda r: r[0])]
    assert x.extract(df.limit(0), found, ["page_id"]).count() == 0


def test_many_different_pages_of_a_host(spark, monkeypatch):
    """Levels of alignment, linear alignment and generalised wrappers leave the texts as they are."""
    rng = random.Random(3)

    def page():
        parts = [f"<{t}>{rng.choice('abc')}{i}</{t}>" for i, t in enumerate(rng.choices(["p", "div", "section", "h2", "nav", "x-y"], k=rng.randint(0, 40)))]
        return f"<body><div class=menu>m</div><article>{''.join(parts)}</article><footer>f</footer></body>"

    rows = [(i, "http://h.x/", page()) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", x.host())

    monkeypatch.setattr(x, "ALIGNED", 5)
    found = x.wrappers(df, Scratch(spark, "t"))
    assert found.count() == 1
    wanted = [(i, "\n".join(re.findall(r"[abc]\d+", re.sub(r"<nav>.*?</nav>", "", p)))) for i, _, p in rows]
    assert sorted(map(tuple, x.extract(df, found, ["page_id"]).collect())) == wanted
    for name, value in (("LONG", 8), ("PAIRS", 0)):
        monkeypatch.setattr(x, name, value)
    wrapper = x.infer([x.fold([(t, False, False) for t, _ in x.stream(p)]) for _, _, p in rows])
    assert len(wrapper) <= 30
    role = x.roles(wrapper)
    assert [(i, x.text_of(p, role)) for i, _, p in rows] == wanted


def test_places():
    e = x.Expression([("a", False, False), ("(b c?)", True, True), ("b", True, False), ("d", False, True)])
    tokens = lambda s: (at := e.places(s.split())) and [e.code[i][0] for i in at]
    for s in ("a d", "a b d", "a b c b b c d d d"):
        assert tokens(s) == s.split()
    assert tokens("a c d") is None and tokens("a") is None and x.Expression([]).places([]) == []
    p = e.places("a b c b c d".split())
    assert p[1] == p[3] and p[2] == p[4]


def test_neighbours_tell_the_template_from_the_text(spark):
    """A text that stands in a place of all different pages of a host is the template's, wherever its tags are."""
    page = lambda i: f"<div><p>Share this story</p></div><article><h1>Title {i}</h1><p>Written for you</p><p>text {i}</p></article>"
    menu = lambda i: f"<ul><li>Start</li><li>Contact</li></ul><div><p>words {i}</p></div>"
    rows = [(i, "http://many.x", page(i)) for i in range(4)] + [(10, "http://one.x", page(0)), (11, "http://copies.x", page(0))]
    rows += [(12 + i, "http://copies.x", f"<nav>{i}</nav>" + page(0)) for i in range(4)] + [(20 + i, "http://menu.x", menu(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", x.host())
    got = {r["page_id"]: r["text"] for r in x.extract(df, x.wrappers(df, Scratch(spark, "t")), ["page_id"]).collect()}
    assert [got[i] for i in range(4)] == [f"Title {i}\ntext {i}" for i in range(4)]
    assert {got[i] for i in range(10, 16)} == {"Title 0\nWritten for you\ntext 0"}
    assert [got[20 + i] for i in range(4)] == [f"words {i}" for i in range(4)]


def test_odd_tags(spark):
    assert x.text_of("<article><a+b>one</a+b><c(d>two</c(d></article>", x.roles(x.infer([[(t, False, False) for t, _ in x.stream("<article><a+b>one</a+b><c(d>two</c(d></article>")]]))) == "one\ntwo"


def test_query(spark):
    got = {r["page_id"]: r for r in queries.op10_extraction(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", q).replace("<br>", " ")).split()) for q in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(q for q in parts if q)
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"], got[p["page_id"]]["url"]) == (want, len(want), p["url"])
