"""What grows with the input: tasks, not what a task or the number of batches holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.config import Config
from pagemill.operators import metadata as MD
from pagemill.operators import requests as RQ
from pagemill.operators import tokens as K
from pagemill.session import tune
from pagemill.streaming import stream as ST


def test_tasks_grow_with_the_html(spark):
    pages = spark.range(12).select(F.col("id").alias("page_id"), F.repeat(F.lit("x"), K.TASK_CHARS // 2).alias("html"))
    assert K.page_partitions(pages) == 6
    assert K.page_partitions(pages, 3) == 3
    assert K.page_partitions(pages.limit(0)) == 4


def test_collections_come_from_sorted_rows(spark):
    tune(spark)
    g = spark.range(9).groupBy((F.col("id") % 3).alias("k")).agg(F.collect_list("id").alias("ids"))
    assert "ObjectHashAggregate" not in g._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_batches_do_not_grow_with_files(spark, tmp_path):
    spark.range(40).repartition(13).write.parquet(str(tmp_path / "in"))
    assert ST._files_a_batch(spark, str(tmp_path / "in")) == 4


def test_salted_tables_are_not_broadcast(spark):
    requests = spark.createDataFrame([(1, "h", "/a", "GET", "")], "req_id long, host string, path string, method string, accept string")
    routes = spark.createDataFrame([("h", "a", 7)], "route_host string, route string, routed_id long")
    states = spark.createDataFrame([(7, None, True, True)], "page_id long, deny_reason string, known boolean, has_doc boolean")
    out = RQ.classify_rows(requests, routes, states, Config())
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
    assert out.first().page_id == 7


def test_decoded_strings_are_not_copied_with_each_piece(spark):
    df = spark.createDataFrame([(1, "a &amp; b", "k"), (2, None, "l")], "id long, t string, other string")
    out = MD.decode_entities(df, "id", ["t"])
    assert sorted(map(tuple, out.collect())) == [(1, "a & b", "k"), (2, None, "l")]
    assert "first(t#" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_frequent_in_a_small_host(spark):
    from pagemill.llm import quality
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60)).translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(i, "s", f"one common line here\n{own(i)}" if i < 6 else own(i)) for i in range(40)]
    out = quality.line_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {r.doc_id for r in out if r.n_line_words} == set(range(6))


def test_text_and_its_references_are_one_row(spark):
    html = ["a &amp; b &quot;c&quot;<b>x</b>", " &#32;<i>y</i>", "&nosuch; & 1 < 2 &#65;&Aacute;&#x110000;", "t &lt;b&gt; <unclosed"]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    one, many = ({i: [r for r in K.page_tokens(pages, runs=runs).orderBy("page_id", "pos").collect() if r.page_id == i] for i in range(len(html))} for runs in (True, False))
    for i in range(len(html)):
        assert "".join(r.tok for r in one[i]) == "".join(r.tok for r in many[i]) == html[i]
        assert "".join(r.text or "" for r in one[i]) == "".join(r.text or "" for r in many[i])
        assert [r.tok for r in one[i] if r.kind in ("open", "close")] == [r.tok for r in many[i] if r.kind in ("open", "close")]
    assert [r.kind for r in one[0]] == ["entity", "open", "text", "close"] and len(many[0]) == 9
    assert [r.kind for r in one[1]] == ["entity", "open", "text", "close"]
    assert len(one[2]) == 3 and len(one[3]) == 3


def test_passes_over_token_rows(spark):
    from pagemill.plans.convert import html_to_markdown
    tune(spark)
    pages = spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string")
    plan = html_to_markdown(pages, Config())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 22 and plan.count("Sort [") <= 13 and "BroadcastHashJoin" not in plan


def test_lists_and_tables_end_as_before_in_one_sort(spark, render):
    got = render(["<ul><li>a<table><tr><td>1<td>2<tr><td>3</table><li>b<dl><dt>x<dd>y</dl><li>c</ul>"])[0]
    assert got is not None and [w for w in got.split() if w.isalnum()] == ["a", "1", "2", "3", "b", "x", "y", "c"]


def test_rows_outside_the_root_go_before_exclusions(spark):
    from pagemill.plans.convert import structured_tokens
    html = "<head><title>t</title></head><body><nav>n</nav><article>a<nav>x</nav>b</article>c</body>"
    pages = spark.createDataFrame([(1, "u", html), (2, "u", "<p>no root")], "page_id long, url string, html string")
    out = structured_tokens(pages, Config()).orderBy("page_id", "pos").collect()
    assert all(r.page_id == 1 and r.root_lo < r.pos <= r.root_hi for r in out)
    assert [r.text for r in out if r.text and not r.excluded] == ["a", "b"] and [r.text for r in out if r.text and r.excluded] == ["x"]


def test_blocks_and_their_cells_are_gathered_in_one_aggregation(spark, render):
    from pagemill.plans.convert import html_to_markdown
    tune(spark)
    pages = spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string")
    plan = html_to_markdown(pages, Config())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate(") <= 10
    got = render(["<table><tr><td></table>", "<table><tr><th>a|b<th><tr><td><td>c<td><tr><td>d</table>"])
    assert got == ["|  |\n| --- |", "| a\\|b |  |  |\n| --- | --- | --- |\n|  | c |  |\n| d |  |  |"]
