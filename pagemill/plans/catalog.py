"""Registered queries: one per operator of SURVEY §2, each `(spark, sf_dir) ->
DataFrame` over the driver's tables (or pages Spark builds from them).  Column names
and types match the DuckDB oracles in `oracles.py`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, compile_selector_list
from ..functions import accept as A
from ..functions import text as T
from ..functions.urls import markdown_route, markdown_url
from ..operators import access as AC
from ..operators import markdown as M
from ..operators import metadata as MD
from ..operators import nodes as N
from ..operators import requests as RQ
from ..operators import select as S
from ..operators import store as ST
from ..operators import tokens as K
from ..session import scratch_dir, tune
from ..sources import fixtures as FX
from ..sources import synthetic as SY
from ..sources.pages import admit_pages, load_pages, read_table, write_documents
from .convert import html_to_markdown
from .pipeline import convert_pages, refresh_documents, refresh_store

def _as_of():
    return F.to_timestamp(F.lit(FX.AS_OF))
IMAGES = Config(include_images=True)
NAV_ROOT = Config(document_root_selector="nav", ignore_selectors="")
BODY_ROOT = Config(document_root_selector="body", ignore_selectors="nav, footer, .ad")
NEGOTIATE = Config(enable_content_negotiation=True)


def _pages(spark, sf) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", "url", "html")


def _body(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    return html_to_markdown(pages, cfg).filter("extracted").select("page_id", "body")


def _tokens(spark, sf) -> DataFrame:
    return K.page_tokens(_pages(spark, sf))


# ---------------------------------------------------------------- 2.1 sources / sinks

def q_load_pages(spark, sf):
    pages = load_pages(spark, f"{sf.rstrip('/')}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


def q_admit_pages(spark, sf):
    return admit_pages(SY.response_pages(spark, sf)).select("page_id", "reject_reason")


def q_write_documents(spark, sf):
    docs = convert_pages(_pages(spark, sf), FX.pages_meta(spark, sf), Config(), FX.terms(spark, sf)) \
        .filter(F.col("fail_reason").isNull())
    path = scratch_dir(spark, "documents")
    write_documents(docs, path)
    back = spark.read.parquet(path)
    return back.groupBy("site_id").agg(F.count("*").alias("n_docs"),
                                       F.sum(F.length("document")).cast("long").alias("n_chars"))


def q_stream_pages(spark, sf):
    from ..streaming.stream import stream_pages
    out = stream_pages(spark, sf, Config())
    return out.select("page_id", F.md5("document").alias("doc_md5"))


# ---------------------------------------------------------------- 2.2 page structure

def q_page_tokens(spark, sf):
    t = _tokens(spark, sf)
    return t.groupBy("page_id").agg(
        F.count("*").alias("n_tokens"), F.sum(F.length("tok")).cast("long").alias("n_chars"),
        F.sum(F.when(t.kind == "open", 1).otherwise(0)).cast("long").alias("n_open"),
        F.sum(F.when(t.kind == "close", 1).otherwise(0)).cast("long").alias("n_close"),
        F.sum(F.when(t.kind == "comment", 1).otherwise(0)).cast("long").alias("n_comment"),
        F.sum(F.when(t.kind == "raw", 1).otherwise(0)).cast("long").alias("n_raw"),
        F.sum(F.when(t.kind == "entity", 1).otherwise(0)).cast("long").alias("n_entity"))


def q_page_nodes(spark, sf):
    n = N.page_nodes(_tokens(spark, sf))
    return n.groupBy("page_id", "tag").agg(F.count("*").alias("n_nodes"),
                                          F.sum(F.col("closed").cast("int")).cast("long").alias("n_closed"),
                                          F.max("depth").cast("long").alias("max_depth"))


def q_tag_attributes(spark, sf):
    pages = _pages(spark, sf).unionByName(_apart(SY.attribute_pages(spark, sf)))
    t = K.page_tokens(pages).filter((F.col("kind") == "open") & (F.col("tag") == "a"))
    return t.groupBy("page_id").agg(F.count("*").alias("n_links"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.col("attrs").getItem("href").alias("h")))),
        lambda x: x["h"]), " ").alias("hrefs"))


#: Page ids of pages built from base rows, beside those of the pages table.
APART = 10_000_000_000


def _apart(pages: DataFrame) -> DataFrame:
    return pages.withColumn("page_id", F.col("page_id") + APART)


def q_normalize_text(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", T.normalize_text(F.col("text")).alias("norm"),
                    T.normalize_inline(F.col("text")).alias("inline"))


def q_drop_padding(spark, sf):
    """Tokens removed and kept per page."""
    t = N.with_tree(N.element_spans(_tokens(spark, sf)))
    kept = N.drop_padding(t).groupBy("page_id").agg(F.count("*").alias("n_kept"))
    return t.groupBy("page_id").agg(F.count("*").alias("n")).join(kept, "page_id", "left").select(
        "page_id", (F.col("n") - F.coalesce("n_kept", F.lit(0))).alias("n_padding"))


def q_decode_entities(spark, sf):
    pages = _pages(spark, sf).unionByName(_apart(SY.reference_pages(spark, sf)))
    t = K.page_tokens(pages).filter(F.col("kind") == "entity")
    return t.groupBy("page_id").agg(F.count("*").alias("n_entities"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("decoded"))


def q_plain_text(spark, sf):
    return K.plain_text(_tokens(spark, sf))


# ---------------------------------------------------------------- 2.3 selection

def _structured(spark, sf, cfg=Config(), pages=None):
    from .convert import structured_tokens
    return structured_tokens(pages if pages is not None else _pages(spark, sf), cfg)


def _with_tree(pages):
    return N.with_tree(N.element_spans(K.page_tokens(pages)))


def q_match_selector(spark, sf):
    t = _with_tree(SY.selector_pages(spark, sf))
    sels = {"child": ".region > .k1", "desc": "main .hot", "compound": "div.nation.k2", "id": "#n3"}
    t = S.match_selectors(t, {f"m_{name}": compile_selector_list(s)[0] for name, s in sels.items()})
    key = F.regexp_extract(F.col("attrs").getItem("id"), r"^n(\d+)$", 1)
    return t.groupBy("page_id").agg(*[F.array_join(F.array_sort(F.collect_list(
        F.when(F.col(f"m_{n}"), F.lpad(key, 12, "0")))), ",").alias(n) for n in sels])


def q_match_any(spark, sf):
    t = _with_tree(_pages(spark, sf))
    t = S.match_any(t, compile_selector_list("h1, .ad\nnav, ul > li"), "m")
    return t.groupBy("page_id").agg(F.sum(F.col("m").cast("int")).cast("long").alias("n_matches"))


def q_main_content(spark, sf):
    cfg = Config(document_root_selector="#missing, .ad, article")
    t = S.main_content(N.element_spans(K.page_tokens(_pages(spark, sf))), cfg)
    root = t.filter(F.col("pos") == F.col("root_lo"))
    return root.select("page_id", F.col("tag").alias("root_tag"),
                       F.coalesce(F.col("attrs").getItem("class"), F.lit("")).alias("root_class"),
                       F.col("root_rank").cast("long").alias("root_rank"))


def _visible_text(t: DataFrame) -> DataFrame:
    """Text of the selected content; every tag or comment counts as a space."""
    c = S.content_subtree(t).filter(F.col("kind") != "raw")
    piece = F.when(F.col("kind").isin("text", "entity"), F.col("text")).otherwise(F.lit(" "))
    return c.groupBy("page_id").agg(T.normalize_inline(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", piece.alias("s")))), lambda x: x["s"]), "")).alias("text"))


def q_drop_excluded(spark, sf):
    pages = _pages(spark, sf).unionByName(_apart(SY.open_nav_pages(spark, sf)))
    return _visible_text(_structured(spark, sf, BODY_ROOT, pages))


def q_content_subtree(spark, sf):
    return _visible_text(_structured(spark, sf))


# ---------------------------------------------------------------- 2.4 Markdown

def q_md_headings(spark, sf):
    return _body(SY.heading_pages(spark, sf))


def q_md_paragraphs(spark, sf):
    b = M.markdown_blocks(S.content_subtree(_structured(spark, sf)), Config())
    return b.filter((F.col("bkind") == "para") & (F.col("text") != "")).select("page_id", F.col("upos").cast("long").alias("upos"), "text") \
        .groupBy("page_id").agg(F.count("*").alias("n_para"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("upos", "text"))), lambda x: x["text"]), "\n\n").alias("paras"))


def q_md_breaks(spark, sf):
    return _body(SY.break_pages(spark, sf))


def q_md_strong(spark, sf):
    """Bold lead-ins of the fixture pages (`<p><b>...<br>`, never closed)."""
    b = M.markdown_blocks(S.content_subtree(_structured(spark, sf)), Config())
    s = b.filter(F.col("text").startswith("**") & (F.col("bkind") == "para"))
    return _bold_counts(s).unionByName(_bold_counts(M.markdown_blocks(
        S.content_subtree(_structured(spark, sf, pages=_apart(SY.bold_block_pages(spark, sf)))), Config()).filter(F.col("text") != "")))


def _bold_counts(s: DataFrame) -> DataFrame:
    return s.groupBy("page_id").agg(F.count("*").alias("n_strong"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("upos", "text"))), lambda x: x["text"]), "\n").alias("strong"))


def q_md_emphasis(spark, sf):
    return _body(SY.emphasis_pages(spark, sf))


def q_md_strikethrough(spark, sf):
    return _body(SY.strike_pages(spark, sf))


def q_md_inline_code(spark, sf):
    return _body(SY.backtick_pages(spark, sf))


def q_md_fenced_code(spark, sf):
    return _body(SY.code_pages(spark, sf))


def q_longest_run(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select("p_partkey", T.longest_run(SY.backtick_text(F.col("p_partkey"), F.col("p_name"))).cast("long")
                    .alias("longest"))


def q_md_links(spark, sf):
    return _body(_pages(spark, sf), NAV_ROOT).unionByName(_body(_apart(SY.card_pages(spark, sf))))


def q_md_unordered_lists(spark, sf):
    return _body(SY.bullet_pages(spark, sf))


def q_md_ordered_lists(spark, sf):
    return _body(SY.ordered_list_pages(spark, sf))


def q_md_nested_lists(spark, sf):
    return _body(SY.nested_list_pages(spark, sf))


def q_md_blockquotes(spark, sf):
    return _body(SY.quote_pages(spark, sf))


def q_md_rules(spark, sf):
    return _body(SY.rule_pages(spark, sf))


def q_md_images(spark, sf):
    return _body(SY.image_pages(spark, sf), IMAGES)


def q_md_figures(spark, sf):
    return _body(SY.figure_pages(spark, sf), IMAGES)


def q_md_captions(spark, sf):
    return _body(SY.caption_pages(spark, sf))


def q_image_source(spark, sf):
    t = K.page_tokens(SY.image_pages(spark, sf)).filter((F.col("kind") == "open") & (F.col("tag") == "img"))
    return t.select("page_id", M.image_source(F.col("attrs")).alias("src"))


def q_image_escape(spark, sf):
    t = K.page_tokens(SY.image_pages(spark, sf)).filter((F.col("kind") == "open") & (F.col("tag") == "img"))
    a = F.col("attrs")
    return t.select("page_id", T.image_text_escape(F.coalesce(a.getItem("alt"), F.lit(""))).alias("alt"),
                    T.image_title_escape(F.coalesce(a.getItem("title"), F.lit(""))).alias("title"))


def q_image_url_clean(spark, sf):
    t = K.page_tokens(SY.image_pages(spark, sf)).filter((F.col("kind") == "open") & (F.col("tag") == "img"))
    return t.select("page_id", M.image_url_ok(M.image_source(F.col("attrs"))).alias("kept"))


def q_md_tables(spark, sf):
    return _body(SY.table_pages(spark, sf).unionByName(_apart(SY.uneven_table_pages(spark, sf))))


def q_md_quote_in_list(spark, sf):
    return _body(SY.quote_in_list_pages(spark, sf))


def q_md_list_in_quote(spark, sf):
    return _body(SY.list_in_quote_pages(spark, sf))


def q_md_code_in_item(spark, sf):
    return _body(SY.code_in_item_pages(spark, sf))


def q_md_table_in_item(spark, sf):
    return _body(SY.table_in_item_pages(spark, sf))


def q_md_private_use(spark, sf):
    return _body(SY.private_use_pages(spark, sf))


def q_md_table_cells(spark, sf):
    return _body(SY.cell_pages(spark, sf))


def q_drop_elements(spark, sf):
    return _body(SY.transparent_pages(spark, sf))


def q_transparent_elements(spark, sf):
    return _body(SY.wrapper_pages(spark, sf))


def q_cleanup_lines(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", M.cleanup_lines(F.col("text")).alias("cleaned"))


def q_markdown_body(spark, sf):
    return _body(_pages(spark, sf))


# ---------------------------------------------------------------- 2.5 metadata

def _fm(spark, sf):
    return MD.front_matter(FX.pages_meta(spark, sf), _pages(spark, sf), FX.terms(spark, sf))


def q_front_matter(spark, sf):
    return _fm(spark, sf).select("page_id", MD.yaml_block(F.col("fm")).alias("yaml"))


def q_excerpt(spark, sf):
    fm = _fm(spark, sf)
    ex = F.filter("fm", lambda e: e["key"] == "excerpt")
    return fm.select("page_id", F.try_element_at(F.try_element_at(ex, F.lit(1))["vals"], F.lit(1)).alias("excerpt"))


def q_taxonomy_terms(spark, sf):
    tx = MD.taxonomy_terms(FX.terms(spark, sf))
    e = tx.select("page_id", F.explode("tax").alias("t"))
    return e.select("page_id", F.col("t.key").alias("key"), F.array_join("t.vals", "|").alias("vals"))


def q_yaml_key(spark, sf):
    d = read_table(spark, sf, "documents")
    raw = F.concat(F.col("lang"), F.lit(" -- "), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("!"))
    return d.select("doc_id", T.yaml_key(raw).alias("key"))


def q_yaml_scalar(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.yaml_scalar(F.col("text")).alias("scalar"))


def q_yaml_block(spark, sf):
    c = read_table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
                                             lambda x: x["text"]).alias("turns"),
                                 F.min("role").alias("first_role"))
    fm = F.array(F.struct(F.lit("Conversation ID").alias("key"), F.lit(False).alias("is_list"),
                          F.array(F.col("conv_id").cast("string")).alias("vals")),
                 F.struct(F.lit("__").alias("key"), F.lit(False).alias("is_list"), F.array(F.lit("dropped")).alias("vals")),
                 F.struct(F.lit("role").alias("key"), F.lit(False).alias("is_list"), F.array("first_role").alias("vals")),
                 F.struct(F.lit("Turns").alias("key"), F.lit(True).alias("is_list"), F.col("turns").alias("vals")))
    return g.select("conv_id", MD.yaml_block(fm).alias("yaml"))


def q_markdown_url(spark, sf):
    return _pages(spark, sf).select("page_id", markdown_url(F.col("url")).alias("markdown_url"))


def q_alternate_link(spark, sf):
    sv = AC.servable_pages(FX.pages_meta(spark, sf), FX.page_flags(spark, sf), Config())
    ok = sv.filter(F.col("deny_reason").isNull()).join(_pages(spark, sf).select("page_id", "url"), "page_id")
    return ok.select("page_id", MD.alternate_link(markdown_url(F.col("url"))).alias("link"))


def _failing(spark, sf) -> DataFrame:
    """The pages with response columns (some refused), one in eight without content."""
    p = SY.response_pages(spark, sf)
    return p.withColumn("html", F.when(F.col("page_id") % 8 == 5, F.lit("<html><body><article> </article></body></html>")).otherwise(F.col("html")))


def q_convert_pages(spark, sf):
    d = convert_pages(_failing(spark, sf), FX.pages_meta(spark, sf).filter(F.col("page_id") % 31 != 8), Config(), FX.terms(spark, sf))
    return d.select("page_id", "document", "fail_reason")


def q_assemble_document(spark, sf):
    c = read_table(spark, sf, "conversations")
    yaml = F.concat(F.lit("role: "), T.yaml_scalar(F.col("role")), F.lit("\n"))
    return c.select("conv_id", "turn", MD.assemble_document(yaml, F.col("text")).alias("document"))


# ---------------------------------------------------------------- 2.6 access / requests

def _servable(spark, sf, cfg=Config()):
    return AC.servable_pages(FX.pages_meta(spark, sf), FX.page_flags(spark, sf), cfg)


def q_enabled_types(spark, sf):
    return AC.enabled_types(FX.pages_meta(spark, sf), Config()).select("page_id", "type")


def q_not_protected(spark, sf):
    return AC.not_protected(FX.pages_meta(spark, sf)).select("page_id")


def q_not_noindex(spark, sf):
    return AC.not_noindex(FX.pages_meta(spark, sf), FX.page_flags(spark, sf), Config()).select("page_id")


def q_servable_pages(spark, sf):
    return _servable(spark, sf).select("page_id", "deny_reason")


def q_markdown_route(spark, sf):
    r = FX.requests(spark, sf)
    return r.select("req_id", "path", markdown_route(F.col("path")).alias("route"))


def q_resolve_requests(spark, sf):
    r = RQ.resolve_requests(FX.requests(spark, sf), _pages(spark, sf), Config())
    return r.select("req_id", "is_md", "page_id")


def q_resolve_indexed(spark, sf):
    """The same with a saved, bucketed table of the routes."""
    path = scratch_dir(spark, "routes")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    RQ.save_routes(_pages(spark, sf), table, path)
    r = RQ.resolve_requests(FX.requests(spark, sf), None, Config(), RQ.saved_routes(spark, table))
    return r.select("req_id", "is_md", "page_id")


def _q1000(c):
    return F.round(c * 1000).cast("long")


def q_accept_ranges(spark, sf):
    r = FX.requests(spark, sf)
    rg = A.accept_ranges(F.col("accept"))
    txt = F.array_join(F.transform(rg, lambda x: F.concat(x["type"], F.lit("/"), x["subtype"], F.lit(";"),
                                                          _q1000(x["quality"]).cast("string"))), ",")
    return r.select("req_id", F.size(rg).cast("long").alias("n_ranges"), txt.alias("ranges"))


def q_media_quality(spark, sf):
    r = FX.requests(spark, sf)
    rg = A.accept_ranges(F.col("accept"))
    md, html = A.media_quality(rg, "text", "markdown"), A.media_quality(rg, "text", "html")
    return r.select("req_id", md["specificity"].cast("long").alias("md_spec"), _q1000(md["quality"]).alias("md_q"),
                    html["specificity"].cast("long").alias("html_spec"), _q1000(html["quality"]).alias("html_q"))


def q_prefers_markdown(spark, sf):
    r = FX.requests(spark, sf)
    return r.select("req_id", A.prefers_markdown(F.col("accept")).alias("conservative"),
                    A.prefers_markdown(F.col("accept"), True).alias("wildcards"))


def _docs_store(spark, sf, cfg=Config(), absent=False):
    """A document store: converted_at spread over the 24 hours before AS_OF, one in six
    stored under other options; with `absent`, pages of odd id were never stored."""
    meta = FX.pages_meta(spark, sf)
    pages = _pages(spark, sf)
    pid = F.col("page_id")
    j = meta.join(pages, "page_id")
    j = j.filter(pid % 2 == 0) if absent else j
    gen_now = ST.fingerprint(F.col("site_id"), pid, F.col("modified_at"), F.col("html"), cfg)
    # Entries written under other options (images on): their fingerprint no longer matches.
    gen_old = ST.fingerprint(F.col("site_id"), pid, F.col("modified_at"), F.col("html"), cfg.replace(include_images=True))
    return j.select("page_id", "site_id", "url", markdown_url(F.col("url")).alias("markdown_url"),
                    F.lit("").alias("front_matter"), F.lit("stored").alias("body"),
                    F.concat(F.lit("---\nurl: "), F.col("url"), F.lit("\n---\n\nstored\n")).alias("document"),
                    F.when(pid % 6 == 0, gen_old).otherwise(gen_now).alias("fingerprint"),
                    F.lit(cfg.generation).alias("generation"),
                    (_as_of() - F.make_interval(hours=(pid % 24).cast("int"), mins=F.lit(30))).alias("converted_at"))


def _classified(spark, sf):
    live = ST.live_documents(_docs_store(spark, sf, NEGOTIATE), _as_of(), NEGOTIATE)
    return RQ.classify_requests(FX.requests(spark, sf), _pages(spark, sf), _servable(spark, sf, NEGOTIATE), live, NEGOTIATE)


def q_classify_requests(spark, sf):
    return _classified(spark, sf).select("req_id", "page_id", "representation", "status", "reason")


def q_classify_stream(spark, sf):
    """The same decisions on the requests as a stream."""
    from ..streaming.stream import stream_requests
    live = ST.live_documents(_docs_store(spark, sf, NEGOTIATE), _as_of(), NEGOTIATE)
    out = stream_requests(FX.requests(spark, sf), _pages(spark, sf), _servable(spark, sf, NEGOTIATE), live, NEGOTIATE)
    return out.select("req_id", "page_id", "representation", "status", "reason")


def q_varies_on_accept(spark, sf):
    return _classified(spark, sf).select("req_id", "varies_on_accept")


# ---------------------------------------------------------------- 2.7 store

def q_fingerprint(spark, sf):
    meta = FX.pages_meta(spark, sf)
    j = meta.join(_pages(spark, sf), "page_id")
    return j.select("page_id", ST.fingerprint(F.col("site_id"), F.col("page_id"), F.col("modified_at"), F.col("html"),
                                              Config()).alias("fingerprint"))


def _fp(spark, sf, cfg):
    j = FX.pages_meta(spark, sf).join(_pages(spark, sf), "page_id")
    return j.select("page_id", ST.fingerprint(F.col("site_id"), F.col("page_id"), F.col("modified_at"), F.col("html"),
                                              cfg).alias("fingerprint"))


def q_stale_pages(spark, sf):
    return ST.stale_pages(_fp(spark, sf, Config()), _docs_store(spark, sf, absent=True), _as_of(), Config()).select("page_id")


def q_expire_documents(spark, sf):
    return ST.expire_documents(_docs_store(spark, sf), _as_of(), Config()).select("page_id")


def q_bump_generation(spark, sf):
    cfg2 = Config().bump_generation()
    return ST.stale_pages(_fp(spark, sf, cfg2), _docs_store(spark, sf, absent=True), _as_of(), cfg2).select("page_id")


def q_refresh_documents(spark, sf):
    snap = refresh_documents(_pages(spark, sf), FX.pages_meta(spark, sf), _docs_store(spark, sf, absent=True), Config(), _as_of(), FX.terms(spark, sf))
    return snap.select("page_id", "generation", "document", (F.col("body") == "stored").alias("from_store"))


def _written_store(spark, sf, **kw) -> str:
    path = scratch_dir(spark, "store")
    ST.write_store(_docs_store(spark, sf, **kw), path)
    return path


def q_refresh_store(spark, sf):
    """refresh_documents on a written store, in place."""
    path = _written_store(spark, sf, absent=True)
    refresh_store(_pages(spark, sf), FX.pages_meta(spark, sf), path, Config(), _as_of(), FX.terms(spark, sf))
    return ST.read_store(spark, path).select("page_id", "generation", "document", (F.col("body") == "stored").alias("from_store"))


def q_purge_store(spark, sf):
    """purge_site on a written store: the site's folders go."""
    path = _written_store(spark, sf)
    ST.purge_store(spark, path, [2])
    return ST.read_store(spark, path).select("page_id", "site_id")


def q_purge_site(spark, sf):
    return ST.purge_site(_docs_store(spark, sf), [2]).select("page_id", "site_id")


def q_retired_documents(spark, sf):
    return ST.retired_documents(_docs_store(spark, sf), _servable(spark, sf)).select("page_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    k[2:]: v for k, v in dict(globals()).items() if k.startswith("q_") and callable(v)
}


def wrapped() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query with the session settings it relies on applied first."""
    def mk(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return f(spark, sf_dir)
        run.__name__ = f.__name__
        return run
    return {k: mk(v) for k, v in QUERIES.items()}
