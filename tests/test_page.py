"""The conversion of a page in one pass: the same as by windows over token rows, without their sorts."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from pagemill.config import Config
from pagemill.operators import markdown as M
from pagemill.operators import page as P
from pagemill.operators import select as S
from pagemill.plans import convert as C
from pagemill.session import tune

TAGS = """p div b strong i em del s a code pre ul ol li blockquote table tr td th thead tbody h1 h2 h3 br hr img span nav article
    section iframe dl dt dd script style noscript x-y header form""".split()
PIECES = ["a", "b c", " ", "\n", "  \t", "\x0b", "\x85", "\u2028", "\xa0", "&amp;", "&lt;b&gt;", "&#65;", "&nosuch;", "&", "<", "|", "*", "# x", "- y", "1. z", "`", "``",
          "\r\n", "\ue001", "\ue010", "\ue020", "\ue040", "\ue041", "&#xe001;", "\x1c", "\u3000", "\xe9", "\n\n\n", "> q", "\x00", "&#0;", "&#xD800;", "$1", "\\", "<!", "<!-- c -->",
          "<!-- ", "<?x", "</", "<1", "]", "[", "&#10;"]
ATTRS = [' class="ad"', " id=content", " href='/x?a=1&amp;b'", ' href=""', ' src="/i.png" alt="A [b]" title=\'t"q\'', " src=data:x", ' href = " u v "', ' class="a ad k"', "/",
         ' CLASS=hot id="main-content"', " data-src=/y", " href", ' "x', " <b"]


def soup(rng: random.Random) -> str:
    out, opened = [], []
    for _ in range(rng.randint(1, 60)):
        r = rng.random()
        if r < 0.38:
            t = rng.choice(TAGS)
            out.append(f"<{t.upper() if rng.random() < 0.05 else t}{rng.choice(ATTRS) if rng.random() < 0.2 or t in ('a', 'img') else ''}>")
            opened.append(t)
        elif r < 0.62 and opened:
            out.append(f"</{opened.pop(-1 if rng.random() < 0.75 else rng.randrange(len(opened)))}>")
        elif r < 0.66:
            out.append(f"</{rng.choice(TAGS)}>")
        else:
            out.append(rng.choice(PIECES))
    return rng.choice(["<body><article>%s</article>", "<article>%s", "<body><nav>n</nav>%s"]) % "".join(out)


def both(pages, cfg):
    return [sorted(((r.page_id, r.body, r.extracted) for r in f(pages, cfg).collect()), key=str) for f in (C.body_of_rows, C.html_to_markdown)]


def test_same_as_over_token_rows(spark):
    tune(spark)
    rng = random.Random(21)
    rows = [(i, "u", soup(rng)) for i in range(250)] + [(400, "u", None), (401, "u", ""), (402, "u", "no root"), (None, "u", "<article>no id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for cfg in (Config(include_images=True), Config(document_root_selector="div > .ad, section p, .k", ignore_selectors="ul > li, .hot, div.a b, #content")):
        old, new = both(pages, cfg)
        assert old == new and len(new) > 150


def test_pages_that_share_an_id(spark):
    """Rows with the same id are one page, as they are over token rows; each id comes once."""
    tune(spark)
    rng = random.Random(22)
    rows = [(i, "u", soup(rng)) for i in range(60)]
    old, new = both(spark.createDataFrame(rows * 2, "page_id long, url string, html string"), Config())
    assert old == new and len({r[0] for r in new}) == len(new) > 30


def test_blocks_from_token_rows(spark):
    """Tokens and blocks made a page at a time are those of the operators over token rows."""
    tune(spark)
    rng = random.Random(23)
    rows = [(i, "u", soup(rng)) for i in range(150)]
    pages = spark.createDataFrame(rows + rows[:20] + [(None, "u", "<article>no id"), (999, "u", "none")], "page_id long, url string, html string")
    cfg = Config(include_images=True, ignore_selectors="ul > li, .hot")
    old, new = C.structured_rows(pages, cfg), C.structured_tokens(pages, cfg)
    columns = ["page_id", "pos", "kind", "tag", "is_void", "text", "list_d", "tbl_d", "hi", "closed", "root_lo", "root_hi", "root_rank", "excluded", F.col("attrs")["href"].alias("h")]
    assert {(f.name, f.dataType) for f in old.select(*columns).schema} == {(f.name, f.dataType) for f in new.select(*columns).schema}
    assert sorted(map(str, old.select(*columns).collect())) == sorted(map(str, new.select(*columns).collect()))
    old, new = M.block_rows(S.content_subtree(old), cfg), M.markdown_blocks(S.content_subtree(new), cfg)
    assert [(f.name, f.dataType) for f in old.schema] == [(f.name, f.dataType) for f in new.schema]
    got = new.collect()
    assert sorted(map(str, old.collect())) == sorted(map(str, got)) and len(got) > 300
    assert "Window" not in new._jdf.queryExecution().executedPlan().toString()


def test_no_pass_over_token_rows(spark):
    """The HTML is moved and sorted once, by page; no window, no row a token."""
    tune(spark)
    pages = spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string")
    out = C.html_to_markdown(pages, Config())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("Sort [") <= 1 and plan.count("Exchange") == 1


def test_bytes_that_are_no_text(spark):
    pages = spark.range(1).select(F.col("id").alias("page_id"), F.concat(F.lit("<article>a"), F.unhex(F.lit("FF")).cast("string"), F.lit("b")).alias("html"))
    old, new = both(pages, Config())
    assert old == new == [(0, "a\ufffdb", True)]


def test_long_and_deep_pages_are_linear():
    """Ten times the page takes about ten times as long."""
    selection = P.Selection(Config())
    shapes = [lambda n: "<article>" + "<p>x <b>y</b>" * n, lambda n: "<article><ul>" + "<li>a" * n, lambda n: "<article><table>" + "<tr><td>1<td>2" * n, lambda n: "<article>" + "<b>" * n + "x",
              lambda n: "<article><p>" + " \u2003" * n + "x", lambda n: "<article><a " + "q=1 " * n + "href=/x>t</a>", lambda n: "<article>" + "<a href=x>" * n, lambda n: "<article>" + "<b><i></i></b>" * n, lambda n: "<article>" + "&amp;x" * n,
              lambda n: "<article><!-- " * n, lambda n: "<article><pre>" + "`\n" * n]

    def seconds(page):
        best = 9.0
        for _ in range(3):
            t = time.perf_counter()
            P.convert([page], selection, False)
            best = min(best, time.perf_counter() - t)
        return best
    for i, shape in enumerate(shapes):
        assert seconds(shape(10_000)) < 25 * seconds(shape(1_000)) + 0.05, i
