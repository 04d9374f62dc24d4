"""Container paths, characters that the conversion marks with, parents' ends, and pages made to be slow."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import nodes as N
from pagemill.operators import tokens as K

PAGES = "page_id long, url string, html string"

# (HTML, Markdown): blocks keep their place in the quotes and lists around them.
NESTED = [
    ("<ul><li>a<blockquote><p>q1</p><p>q2</p></blockquote></li><li>b</li></ul>", "- a\n\n  > q1\n  > \n  > q2\n\n- b"),
    ("<blockquote>t<ul><li>a<li>b<ul><li>c</ul></ul><p>u</p></blockquote>", "> t\n> \n> - a\n> - b\n>   - c\n> \n> u"),
    ("<ul><li>a<pre>x\n\n  y</pre></li><li>b<table><tr><td>1<td>2</table></li></ul><p>end</p>",
     "- a\n\n  ```\n  x\n\n    y\n  ```\n\n- b\n\n  | 1 | 2 |\n  | --- | --- |\n\nend"),
    ("<ol><li>a<pre>x</pre><ol><li>n<pre>d\n\nc</pre></ol><li>b</ol>",
     "1. a\n\n   ```\n   x\n   ```\n\n  1. n\n\n     ```\n     d\n\n     c\n     ```\n\n2. b"),
    ("<ul><li>a<blockquote>q<ul><li>in<blockquote><pre>c\n\nd</pre></blockquote></ul></blockquote>tail</ul>",
     "- atail\n\n  > q\n  > \n  > - in\n  > \n  >   > ```\n  >   > c\n  >   >\n  >   > d\n  >   > ```"),
    ("<blockquote>one</blockquote><blockquote>two</blockquote>", "> one\n\n> two"),
    ("<blockquote><h2>h</h2><hr><blockquote>z<p>w</p></blockquote></blockquote><p>b</p>", "> ## h\n> \n> ---\n> \n> > z\n> >\n> > w\n\nb"),
    ("<blockquote>&gt;<br>&gt;&gt;<br><br>x</blockquote>", "> >\n> >>\n> \n> x"),
    ("<table><tr><td><blockquote>c</blockquote><ul><li>d</ul></table><blockquote>e</blockquote>", "| cd |\n| --- |\n\n> e"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "a\n\nb\n\nc"),
    ("<ul><li></li><li>x</ul>", "- \n- x"),
]


def test_nested_blocks(render):
    assert render([h for h, _ in NESTED]) == [w for _, w in NESTED]


def test_every_private_use_character_survives(spark, render):
    every = "".join(map(chr, range(0xE000, 0xF900)))
    parts = [every[i:i + 640] for i in range(0, len(every), 640)]
    edge = "\ue000\ue001\ue01f\ue020\ue03f\ue040"
    pairs = [a + b for a in edge for b in edge]  # marks, their stand-ins and the escape, side by side
    texts = [*parts, "".join(pairs)]
    html = [f"<p>x{t}<b>{t}</b><a href='/{t}'>{t}</a></p><pre>{t}</pre>" for t in texts]
    assert render(html) == [f"x{t}**{t}**[{t}](/{t})\n\n```\n{t}\n```" for t in texts]
    pages = spark.createDataFrame([(i, "u", f"<p>{t}&#10;</p>{t}") for i, t in enumerate(texts)], PAGES)
    assert {r.page_id: r.text for r in K.plain_text(K.page_tokens(pages)).collect()} == {i: f"{t}\n{t}" for i, t in enumerate(texts)}


def test_metadata_keeps_every_character(spark):
    from pagemill.operators.metadata import decode_entities
    rows = [(1, "&amp;a", "b&#10;"), (2, "", None), (3, None, "&lt;&amp;lt;")]
    got = decode_entities(spark.createDataFrame(rows, "k long, a string, b string"), "k", ["a", "b"])
    assert sorted(map(tuple, got.select("k", "a", "b").collect())) == [(1, "&a", "b\n"), (2, "", None), (3, None, "<&lt;")]


def spans(spark, html):
    df = N.element_spans(K.page_tokens(spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], PAGES)))
    out = {}
    for r in df.filter(F.col("kind") == "open").select("page_id", "tag", "pos", "hi", "closed").collect():
        out.setdefault(r.page_id, {})[r.tag] = (r.pos, r.hi, r.closed)
    return out


def test_ends_within_parents(spark):
    got = spans(spark, ["<div><section>A</div>B</section>C", "<x-a><p>a</x-a>b</p>", "<x-a><b>a</x-a>b</b>c", "<dl><dt>a<dd>b<p>c</dl>d"])
    assert got[0] == {"div": (0, 3, True), "section": (1, 2, False)}  # its close comes after its parent's
    assert got[1]["p"] == (1, 2, False) and got[2]["b"][1] == 2
    assert got[3]["dt"] == (1, 2, False) and got[3]["dd"] == (3, 6, False)


def test_unclosed_raw_elements_and_tags(spark):
    def tokens(h):
        rows = K.page_tokens(spark.createDataFrame([(1, "u", h)], PAGES)).orderBy("pos").collect()
        assert "".join(r.tok for r in rows) == h
        return [(r.kind, r.tok) for r in rows]
    assert tokens("<p>a<!-- x <b>y") == [("open", "<p>"), ("text", "a"), ("comment", "<!-- x <b>y")]
    assert tokens("a<SCRIPT>x<b>") == [("text", "a"), ("raw", "<SCRIPT>x<b>")]
    assert tokens("<script-x>y") == [("open", "<script-x>"), ("text", "y")]
    assert tokens("x <b &amp; c") == [("text", "x "), ("text", "<"), ("text", "b "), ("entity", "&amp;"), ("text", " c")]
    assert tokens('<a title="x>y') == [("open", '<a title="x>'), ("text", "y")]
    assert tokens("<!-->b") == [("comment", "<!-->"), ("text", "b")]


def test_no_page_is_slow(spark):
    """128 KB pages on which a search for an end that isn't there would start again at every tag: ten
    of them together in less time than one took."""
    html = ["<script>" * 16000, "<style x" * 16000, "<!--" * 32000, "<!" * 64000, "<a" * 64000, '<a "' * 32000, "<a '>' " * 16000, "<a <b " * 20000 + '"x>',
            "</script " * 14000, "&#1" * 40000]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], PAGES)
    pages.select(T.strip_tags("html")).filter("page_id < 0").collect()
    start = time.time()
    n = K.page_tokens(pages).groupBy("page_id").agg(F.sum(F.length("tok")).alias("n")).collect()
    stripped = pages.select(F.length(T.strip_tags("html"))).collect()
    assert sorted(r.n for r in n) == sorted(map(len, html)) and len(stripped) == len(html)
    assert time.time() - start < 20


def test_strip_tags(spark):
    cases = [("a<script>x</script>b", "ab"), ("a<script>x<style>y</style>z<b>w", "axzw"), ("<style>q<script>r</script>t", "qt"),
             ("a < b > c <d", "a < b > c"), ("x<!--y <b>z", "x"), ("<p>a</p>\n <i>b</i>", "a b")]
    got = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string").select("i", T.strip_tags("h").alias("t")).collect()
    assert [r.t for r in sorted(got)] == [w for _, w in cases]


def test_plans_dont_grow_with_selectors(spark):
    """Ten selectors of two or three steps take as many windows and sorts as two; what each selects
    is what it selects alone."""
    from pagemill.config import compile_selector_list
    from pagemill.operators import select as S
    html = "<div class='a'><p id='x'>1</p><section><p>2<b>3</b></p></section></div><ul><li>4<ul><li><p>5</p></ul></ul><p>6</p>"
    t = N.with_tree(N.element_spans(K.page_tokens(spark.createDataFrame([(1, "u", html)], PAGES)))).cache()
    texts = ["div p", "div > p", "ul li p", "ul > li > p", ".a section > p", "li li", "div > section b", "p > b", "ul ul > li", "section p b"]
    many = {f"s{i}": compile_selector_list(x)[0] for i, x in enumerate(texts)}

    def steps(names):
        plan = S.match_selectors(t, {n: many[n] for n in names})._jdf.queryExecution().sparkPlan().toString()
        return plan.count("Window "), plan.count("Sort "), plan.count("Generate ")
    assert steps(many) == steps(["s2", "s3"])
    rows = S.match_selectors(t, many).filter(F.col("kind") == "open").collect()
    for n, sel in many.items():
        alone = S.match_selector(t, sel, "m").filter("m").collect()
        assert sorted(r.pos for r in rows if r[n]) == sorted(r.pos for r in alone)
    got = {x: len([r for r in rows if r[f"s{i}"]]) for i, x in enumerate(texts)}
    assert got == {"div p": 2, "div > p": 1, "ul li p": 1, "ul > li > p": 1, ".a section > p": 1, "li li": 1, "div > section b": 1, "p > b": 1, "ul ul > li": 1, "section p b": 1}
