import re
from html import unescape

from intakeflow.llm import htmltext as H


def texts(page):
    return [b.text for b in H.blocks(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>c<br>d<p>e&nbsp;&amp;&#233;</div>f") == ["a bc d", "e &é", "f"]
    assert texts("<script>x<p>y</p></script>z<!-- <p>no</p> --><style>p{}</style>") == ["z"]
    assert texts('<a title="x > y">t</a> 1 < 2 <') == ["t 1 < 2 <"]
    assert texts("<div class='q><p>x</p>") == ["x"]
    assert texts("") == texts("   ") == texts("<script>never closed") == texts("<!-- open") == []
    assert [b.path for b in H.blocks("<ul><li>a<li>b</ul>")] == [("ul", "li")] * 2
    assert texts("<p>" * 3000 + "deep") == ["deep"]


def test_meaning_of_paths():
    assert H.meant(("html", "body", "article", "p")) is True
    for path in (("body", "nav", "ul", "li"), ("article", "div comments", "p"), ("article", "aside", "p"),
                 ("body", "div ad"), ("article", "div cookie-notice"), ("body", "p")):
        assert not H.meant(path)
    assert H.meant(("article", "div lead adventure", "p")) is True


def test_held_out_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    net = H.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    for r in H.extract(pages, net).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert r.text == want and r.n_chars == len(want)
    # other layouts, made with other words than those learned from
    good = total = 0
    some = [H.blocks(p) for p in H.made_up(60, seed=99)]
    for bs, on in zip(some, net.labels([H.matrix(b) for b in some])):
        good += sum(bool(H.meant(b.path)) == bool(k) for b, k in zip(bs, on))
        total += len(bs)
    assert good >= 0.97 * total


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>text</p></article>"), (3, "u", "<p>" + "w " * 60_000),
            (4, "u", "<li>a" * 3000), (4, "u", "<li>a" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    net = H.fit(pages)
    out = H.extract(pages.selectExpr("*", "1 as text", "2 as n_chars"), net)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == 6 and {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert [r.text for r in got if r.page_id is None] == ["text"]
    assert H.extract(pages.limit(0), net).count() == 0


def test_opaque_elements_end_where_they_should():
    for name in ("svg", "template", "iframe", "noscript"):
        assert texts(f"<p>a</p><{name} x='1'/><p>b</p><{name}>no</{name}><p>c</p>") == ["a", "b", "c"]
        assert texts(f"<p>a</p><{name} x='1'><p>b</p>") == ["a", "b"]  # never closed
        assert texts(f"<{name}>no <{name}>no</{name}> no</{name}><p>a</p>") == ["a"]
        assert texts(f"<{name}/>" * 3 + f"<{name}>no<!-- </{name}> --> no</{name}><p>a") == ["a"]
    # one end tag is missing: the inner element ends there and the rest stays
    assert texts("<p>a</p><svg><svg>no</svg><p>b</p>") == ["a", "b"]
    assert texts("<svg><title>no</svg><p>a</p><script>'</svg>'</script><p>b</p>") == ["a", "b"]
    assert [b.path for b in H.blocks("<article><svg><path d='x'><p>a</p></article>")] == [("article", "p")]
    assert texts("<svg>" * 3000 + "<p>a</p>") == ["a"]


def test_text_of_math_and_object_stays():
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    assert texts("<p>a</p><math/><p>b</p><object data='x'><param name='y'><p>c</p></object><p>d</p>") == ["a", "b", "c", "d"]
    assert texts("<p>a <object data='x'>b <p>c") == ["a b", "c"]
    assert texts("<p>a <object data='x'/> b</p><p>c") == ["a b", "c"]
