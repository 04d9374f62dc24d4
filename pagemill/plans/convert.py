"""The conversion plan: pages -> tokens -> structure -> root / exclusions -> Markdown
body.  One DataFrame lineage, one page_id exchange of HTML (before tokenizing).  Whole pages are converted
a page at a time; jobs that need the rows between take them from the operators over token rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import markdown as M
from ..operators import nodes as N
from ..operators import page as P
from ..operators import select as S
from ..operators import tokens as K
from ..session import ship


def _needs_tree(cfg: Config) -> bool:
    return any(st.child for steps in cfg.root_steps + cfg.ignore_steps for st in steps)


def whole_pages(pages: DataFrame, cfg: Config, partitioned: bool = False, partitions: int | None = None) -> DataFrame:
    """(page_id, htmls): the HTML of all rows with the id, in one task."""
    ship(pages.sparkSession)
    if not partitioned:
        pages = pages.repartition(K.page_partitions(pages, partitions or cfg.page_partitions), "page_id")
    return pages.groupBy("page_id").agg(F.collect_list(F.col("html").cast("binary")).alias("htmls"))


def structured_tokens(pages: DataFrame, cfg: Config, partitioned: bool = False, partitions: int | None = None) -> DataFrame:
    """The tokens of a page's root, with element spans, root range and exclusion flag, made a page at a time."""
    @F.arrow_udf(f"array<struct<{P.TOKEN}>>")
    def made(htmls: pa.Array) -> pa.Array:
        selection = P.Selection(cfg)
        return P.some_by_some(lambda some: P.token_lists(some, selection), htmls)
    rows = whole_pages(pages, cfg, partitioned, partitions).select("page_id", made("htmls").alias("_t"))
    return rows.select("page_id", F.explode("_t").alias("_t")).select("page_id", "_t.*")


def structured_rows(pages: DataFrame, cfg: Config, partitioned: bool = False, partitions: int | None = None) -> DataFrame:
    """structured_tokens() by the operators over token rows."""
    # Only what later steps read: the raw token text (script bodies included) is
    # dropped so every sort moves narrow rows, as are the keys of tags without attributes.
    t = K.page_tokens(pages, partitioned, partitions or cfg.page_partitions, runs=True)
    t = t.select("page_id", "pos", "kind", "tag", "is_void", F.when(~K.bare_tag(), F.col("attrs")).alias("attrs"), "text")
    t = N.element_spans(t)
    if _needs_tree(cfg):
        t = N.with_tree(t)
    # What lies outside the root excludes nothing in it.
    return S.drop_excluded(S.within_root(S.main_content(t, cfg)), cfg)


def body_of_rows(pages: DataFrame, cfg: Config, partitioned: bool = False, partitions: int | None = None) -> DataFrame:
    """html_to_markdown() by windows and aggregations over token rows: the operators that other jobs use one by one."""
    st = structured_rows(pages, cfg, partitioned, partitions)
    body = M.markdown_body(S.content_subtree(st), cfg)
    return body.select("page_id", "body", F.coalesce("has_content", F.lit(False)).alias("extracted"))


def page_converter(cfg: Config):
    """A function of a page's HTML (all rows that share its id): struct<body, extracted>, null without a root or blocks."""
    images = cfg.include_images

    @F.arrow_udf("struct<body: string, extracted: boolean>")
    def convert(htmls: pa.Array) -> pa.Array:
        selection = P.Selection(cfg)
        out = []
        for page in htmls:
            got = P.convert(P.decoded(page), selection, images)
            out.append(None if got is None else {"body": got[0], "extracted": got[1]})
        return pa.array(out, pa.struct([("body", pa.string()), ("extracted", pa.bool_())]))
    return convert


def html_to_markdown(pages: DataFrame, cfg: Config, partitioned: bool = False, partitions: int | None = None) -> DataFrame:
    """(page_id, body, extracted) for pages that have a root: `extracted` false means
    a blank extraction (failure).  Pages with no root produce no row.  A page is converted in one pass
    (operators/page.py) after the one page_id exchange of HTML."""
    whole = whole_pages(pages, cfg, partitioned, partitions)
    done = whole.select("page_id", page_converter(cfg)("htmls").alias("_d")).filter(F.col("_d").isNotNull())
    return done.select("page_id", "_d.body", "_d.extracted")
