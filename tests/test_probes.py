"""Cases that once went wrong: caps, element ends, references, access, requests, upkeep."""

from pyspark.sql import functions as F

from pagemill.config import Config
from pagemill.functions import accept as A
from pagemill.functions import text as T
from pagemill.operators import access as AC
from pagemill.operators import markdown as M
from pagemill.operators import metadata as MD
from pagemill.operators import nodes as N
from pagemill.operators import requests as RQ
from pagemill.operators import store as ST
from pagemill.operators import tokens as K
from pagemill.plans.pipeline import convert_pages, refresh_documents
from pagemill.sources import fixtures as FX
from pagemill.sources.pages import PAGES_SCHEMA, load_pages, read_table

from .conftest import SF

# Deviations and element ends: HTML, expected Markdown.
CASES = [
    ("<a href='/x'><h3>Title</h3><p>desc</p></a>", "[Titledesc](/x)"),
    ("<b><p>one</p><p>two</p></b>", "**one**\n\n**two**"),                    # emphasis over blocks, marked per block
    ("<i><h2>t</h2><ul><li>q</li></ul></i>", "## *t*\n\n- *q*"),
    ("<p>x" + "<b><i>" * 3 + "</i></b>" * 3 + "y</p>", "xy"),
    ("<a href=/x?a=1>t</a>", "[t](/x?a=1)"),
    ("<a href='/&eacute;&#61;&#38;amp;'>k</a>", "[k](/é=&amp;)"),
    ("x<?xml:namespace\nprefix = o ?>y", "xy"),
    ("&#000065;&#x00041;&#99999999999;", "AA�"),
    ("text<h2>head</h2>text", "text\n\n## head\n\ntext"),                     # every block on its own line
    ("<pre>\n  # no heading\n\n\n\nx</pre>", "```\n  # no heading\n\n\n\nx\n```"),  # code untouched by line rules
    ("<p><b>a</b> <i>b</i></p>", "**a** *b*"),                                # space between inline elements kept
    ("<ul><li>a<pre>x</pre></li></ul>", "- a\n\n  ```\n  x\n  ```"),                # pre inside an item stays a block
]


def test_cases(render):
    got = render([h for h, _ in CASES])
    assert got == [w for _, w in CASES]


def test_exclusions_end_where_they_should(render):
    cfg = Config(ignore_selectors="nav, .ad")
    got = render(["<section><nav>links</section><p>text after</p>", "<span class='a\nad'><div>AD</div></span><p>k</p>"], cfg)
    assert got == ["text after", "k"]


def test_no_size_limit_by_default(spark):
    big = "<html><body><article><p>" + "word " * 1_900_000 + "</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://h/a", big)], PAGES_SCHEMA)
    meta = FX.pages_meta(spark, SF).filter("page_id = 1")
    r = convert_pages(pages, meta, Config()).select("fail_reason", F.length("body").alias("n")).first()
    assert r.fail_reason is None and r.n > 9_000_000
    assert convert_pages(pages, meta, Config(max_html_bytes=100)).first().fail_reason == "too_large"


def test_excerpt_counts_words_after_decoding(spark):
    text = " ".join("&nbsp;" if i % 3 == 2 else f"w{i}" for i in range(100))
    df = spark.createDataFrame([(1, text)], "k long, x string")
    got = MD.decode_entities(df, "k", ["x"]).select(MD.excerpt_finish(F.col("x"))).first()[0]
    assert got.endswith("...") and len(got.split()) == 40


def test_attributes(spark):
    pages = spark.createDataFrame([(1, "u", "<a class='x\n y' TITLE=\"&quot;&amp;lt;\" title=no href=/a?b=c&amp;d>")], PAGES_SCHEMA)
    a = K.page_tokens(pages).filter("kind = 'open'").first().attrs
    assert (a["class"], a["title"], a["href"], a["id"]) == ("x\n y", '"&lt;', "/a?b=c&d", None)


def test_cleanup_trims(spark):
    assert spark.createDataFrame([("\n  # a\n\n\nb \n",)], "t string").select(M.cleanup_lines(F.col("t"))).first()[0] == "# a\n\nb"


def test_padding(spark):
    html = "<body>\n<div> <p>a</p> <b>b</b> c <!-- x --> </div><pre> <i>k</i></pre></body>"
    tree = N.with_tree(N.element_spans(K.page_tokens(spark.createDataFrame([(1, "u", html)], PAGES_SCHEMA))))
    cols = ("pos", "text", "parent_tag")
    gone = tree.select(*cols).exceptAll(N.drop_padding(tree).select(*cols)).orderBy("pos").collect()
    assert [(r.text, r.parent_tag) for r in gone] == [("\n", "body"), (" ", "div"), (" ", "div")]


def test_load_pages_formats(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>a\nb</p>")
    r = load_pages(spark, str(tmp_path / "p.html"), "text").first()
    assert r.html == "<p>a\nb</p>" and r.url.endswith("p.html") and r.page_id is not None
    p = load_pages(spark, f"{SF}/pages.parquet")
    assert p.columns == ["page_id", "url", "html"] and p.count() == 50


def test_access_and_purge(spark):
    meta = spark.createDataFrame([(1, None, "publish", False), (2, "post", "publish", False)], "page_id long, type string, status string, password_protected boolean")
    flags = spark.createDataFrame([], "page_id long, key string, value string")
    assert {r.page_id: r.deny_reason for r in AC.servable_pages(meta, flags, Config()).collect()} == {1: "type_disabled", 2: None}
    store = spark.createDataFrame([(1, 1), (2, None), (3, 2)], "page_id long, site_id long")
    assert {r.page_id for r in ST.purge_site(store, [2]).collect()} == {1, 2}


def test_bad_quality_drops_the_range(spark):
    df = spark.createDataFrame([("text/html;q=high, text/markdown;q=0.5",), (None,)], "h string")
    rows = df.select(A.accept_ranges(F.col("h")).alias("r")).collect()
    assert [(x.type, x.subtype, x.quality) for x in rows[0].r] == [("text", "markdown", 0.5)] and rows[1].r == []


PAGES = [(1, "http://a.test/about"), (2, "http://b.test/about"), (3, "http://a.test/"), (4, "http://b.test"), (5, "http://a.test/x?q=1"), (6, "http://b.test/index")]
REQS = [(1, "a.test", "/about"), (2, "B.test", "/about"), (3, "a.test", "/"), (4, "b.test", "/"), (5, "a.test", "/index.md"), (6, "b.test", "/index.md"),
        (7, "a.test", "/x.md"), (8, "b.test", "/x.md"), (9, None, "/about"), (10, "a.test", "/index")]


def test_routes_by_host(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string")
    reqs = spark.createDataFrame(REQS, "req_id long, host string, path string")
    got = {r.req_id: r.page_id for r in RQ.resolve_requests(reqs, pages, Config()).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 6: 6, 7: 5, 8: None, 9: None, 10: None}
    one = {r.req_id: r.page_id for r in RQ.resolve_requests(reqs.drop("host"), pages, Config(site_front_page_id=9)).collect()}
    assert one[3] == one[4] == one[5] == 9 and one[1] == one[9] == 1
    sites = Config(site_front_page_id=((1, 7), (2, 8)))
    by_site = reqs.withColumn("site_id", F.when(F.lower("host") == "a.test", 1).otherwise(2))
    two = {r.req_id: r.page_id for r in RQ.resolve_requests(by_site, pages, sites).collect()}
    assert (two[3], two[4], two[5], two[6]) == (7, 8, 7, 8)


def test_hot_route_is_spread(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string")
    reqs = spark.range(20_000).select(F.col("id").alias("req_id"), F.lit("a.test").alias("host"), F.lit("/about").alias("path"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = RQ.resolve_requests(reqs, pages, Config()).withColumn("pid", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("pid").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 20_000 and max(sizes) <= 10_000


def test_missing_site_is_no_missing_metadata(spark):
    pages = read_table(spark, SF, "pages").select("page_id", "url", "html").filter("page_id < 2")
    meta = FX.pages_meta(spark, SF).filter("page_id = 0").withColumn("site_id", F.lit(None).cast("long"))
    out = {r.page_id: r.fail_reason for r in convert_pages(pages, meta, Config()).collect()}
    assert out == {0: None, 1: "no_metadata"}


def test_hooks(spark):
    pages = read_table(spark, SF, "pages").select("page_id", "url", "html").filter("page_id < 3")
    d = convert_pages(pages, FX.pages_meta(spark, SF), Config(), FX.terms(spark, SF), include_taxonomy=F.col("taxonomy") != "host",
                      document_fn=lambda c: F.concat(F.lit("<!-- x -->\n"), c)).collect()
    assert all(r.document.startswith("<!-- x -->\n---") and "taxonomy_host" not in r.document for r in d)


def test_refresh_moves_only_stale_pages(spark, tmp_path):
    pages = read_table(spark, SF, "pages").select("page_id", "url", "html")
    meta, as_of = FX.pages_meta(spark, SF), F.to_timestamp(F.lit(FX.AS_OF))
    convert_pages(pages, meta, Config(), None, as_of).drop("fail_reason").write.parquet(str(tmp_path / "s"))
    store = spark.read.parquet(str(tmp_path / "s"))
    same = refresh_documents(pages, meta, store, Config(), as_of)
    assert same.exceptAll(store).count() == 0 and same.count() == store.count()
    assert "html" not in same._jdf.queryExecution().executedPlan().toString()
    some = refresh_documents(pages, meta, store.filter("page_id <> 3"), Config(), as_of)
    assert some.filter("page_id = 3").first().document == store.filter("page_id = 3").first().document
    # a lifetime by page: zero is never live
    ttl = F.when(F.col("page_id") == 4, 0).otherwise(43200)
    assert ST.live_documents(store, as_of, Config(), ttl).filter("page_id = 4").count() == 0
    assert refresh_documents(pages, meta, store, Config(), as_of, ttl=ttl).count() == store.count()


def test_page_that_arrives_twice(spark, tmp_path):
    from pagemill.streaming.stream import convert_stream, current_documents
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    meta = FX.pages_meta(spark, SF)
    html = "<html><body><article><p>{}</p></article></body></html>"
    rows = [[(1, "http://h/a", html.format("one")), (2, "http://h/b", html.format("two"))], [(1, "http://h/a", html.format("new")), (2, "http://h/b", html.format("two"))]]
    for part in rows:
        spark.createDataFrame(part, PAGES_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        convert_stream(spark.readStream.schema(PAGES_SCHEMA).parquet(src), meta, Config(), out, ck).awaitTermination()
    now = {r.page_id: r.body for r in current_documents(spark, out).collect()}
    assert now == {1: "new", 2: "two"}
    assert spark.read.parquet(out).filter("page_id = 2").count() == 1  # unchanged: left alone


def test_named_references_in_attributes(spark):
    got = spark.createDataFrame([("&copy;&nosuch;&amp;copy;&",)], "t string").select(T.decode_references("t")).first()[0]
    assert got == "©&nosuch;&copy;&"
