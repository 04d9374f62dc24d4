import pytest
from pyspark.sql import functions as F

from pagemill.config import Config, ConfigError, compile_selector
from pagemill.functions import accept as A
from pagemill.functions import text as T
from pagemill.functions.urls import markdown_route, markdown_url
from pagemill.sources.fixtures import ACCEPT_HEADERS


def test_selector_compiler():
    s = compile_selector("main > article.post#x.a.a  p")
    assert [st.tag for st in s] == ["main", "article", "p"]
    assert s[1].id == "x" and s[1].classes == ("post", "a") and s[1].child and not s[2].child
    for bad in ["h1 + p", "[data-x]", "a:not(.b)", "> p", "p >", "a#x#y"]:
        with pytest.raises(ConfigError):
            compile_selector(bad)


def test_config_defaults_and_limits():
    c = Config(document_root_selector="   ", ignore_selectors="")
    assert c.document_root_selector.startswith("main, article")
    assert c.ignore_steps == ()
    assert Config(post_types=("post", "attachment", "nope", "page", "post")).enabled_types == ("post", "page")
    assert Config().options_hash != Config(include_images=True).options_hash
    assert Config().bump_generation().generation == 2
    with pytest.raises(ConfigError):
        Config(document_root_selector=".a, " * 150 + "article")
    with pytest.raises(ConfigError):
        Config(ignore_selectors=".a, " * 600)


def test_accept_table(spark):
    # (conservative, with wildcards) per header, FIXTURES.md
    want = [(True, True), (False, False), (False, True), (False, False), (True, True), (False, False),
            (False, False), (False, False), (False, False), (True, True), (True, True), (False, False)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(ACCEPT_HEADERS)], "i int, h string")
    got = df.select("i", A.prefers_markdown(F.col("h")).alias("c"), A.prefers_markdown(F.col("h"), True).alias("w")) \
        .orderBy("i").collect()
    assert [(r.c, r.w) for r in got] == want


def test_markdown_url(spark):
    cases = [("https://example.com", "https://example.com/index.md"),
             ("https://example.com/", "https://example.com/index.md"),
             ("https://example.com/blog/post/", "https://example.com/blog/post.md"),
             ("https://example.com/a.md", "https://example.com/a.md"),
             ("https://u:p@example.com:8080/a?x=1#f", "https://example.com:8080/a.md?x=1#f"),
             ("https://h?q=1", "https://h/index.md?q=1"),
             ("http://h:99999/a", "http://h:99999/a")]
    df = spark.createDataFrame(cases, "u string, want string")
    for r in df.select(markdown_url(F.col("u")).alias("got"), "want").collect():
        assert r.got == r.want


def test_markdown_route(spark):
    cases = [("/a/b.md", "a/b"), ("/a/b.md/", "a/b"), ("/index.md", "index"), ("/x%20y.md", "x y"),
             ("/c++.md", "c++"), ("/a/b", None), ("/.md", None), ("/a.md?x=1", "a")]
    df = spark.createDataFrame(cases, "p string, want string")
    for r in df.select(markdown_route(F.col("p")).alias("got"), "want").collect():
        assert r.got == r.want


def test_yaml_helpers(spark):
    df = spark.createDataFrame([("Ünï Code--Key!", 'a "q"\\\r\nb')], "k string, v string")
    r = df.select(T.yaml_key(F.col("k")).alias("k"), T.yaml_scalar(F.col("v")).alias("v")).first()
    assert r.k == "n_code_key"
    assert r.v == '"a \\"q\\"\\\\\\nb"'


def test_longest_run_and_fences(spark):
    df = spark.createDataFrame([("a``b`",), ("none",), ("",)], "t string")
    got = [r[0] for r in df.select(T.longest_run(F.col("t"))).collect()]
    assert got == [2, 0, 0]
