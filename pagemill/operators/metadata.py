"""Document metadata: front matter, excerpt, taxonomy terms, YAML, Markdown URL,
assembled document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..functions.urls import markdown_url

def decode_entities(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Decode character references in `cols` exactly once (so '&amp;lt;' -> '&lt;').
    The strings are cut into text / reference pieces, each with its column; references are
    resolved by a broadcast lookup of the bounded HTML5 table (numeric ones by arithmetic), and
    the pieces of a column re-joined in order per key.  One aggregation on `key`."""
    ents = T.entity_table(df.sparkSession)

    def cut(i: int, c: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(T.REFERENCE_RX), 0)
        return F.transform(found, lambda t: F.struct(F.lit(i).alias("col"), t.alias("t")))

    # The strings themselves stay behind: a copy with each of its pieces would grow with their square.
    given = {c: f"_given{i}" for i, c in enumerate(cols)}
    others = [c for c in df.columns if c != key and c not in given]
    x = df.select(key, *others, *[F.col(c).isNotNull().alias(g) for c, g in given.items()], F.posexplode_outer(F.concat(*[cut(i, c) for i, c in enumerate(cols)])).alias("_p", "_s"))
    x = x.withColumn("_t", F.col("_s.t"))
    name = F.regexp_extract("_t", r"^&([A-Za-z][A-Za-z0-9]*);$", 1)
    x = x.withColumn("_k", F.when(F.col("_t").startswith("&") & (name != ""), name))
    x = x.join(F.broadcast(ents), x["_k"] == ents["ent_name"], "left")
    piece = F.coalesce(F.col("ent_chars"), T.numeric_entity(F.col("_t")), F.col("_t"))
    whole = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_s.col") == i, F.struct("_p", piece.alias("s"))))),
                                      lambda s: s["s"]), "").alias(f"_dec{i}") for i in range(len(cols))]
    g = x.groupBy(key).agg(*[F.first(c).alias(c) for c in [*others, *given.values()]], *whole)
    decoded = {c: F.when(F.col(given[c]), F.col(f"_dec{i}")).alias(c) for i, c in enumerate(cols)}
    return g.select(*[decoded.get(c, F.col(c)) for c in df.columns])


def excerpt_source(excerpt: Column, content: Column) -> Column:
    """Excerpt source: stripped excerpt, else stripped content, whole - how many words
    there are is known only once references are decoded."""
    e = T.strip_tags(F.coalesce(excerpt, F.lit("")))
    return F.when(e != "", e).otherwise(T.strip_tags(F.coalesce(content, F.lit(""))))


def excerpt_finish(decoded: Column) -> Column:
    """Whitespace collapsed; more than 40 words -> first 40 + '...'; '' -> NULL."""
    v = T.collapse_ws(decoded)
    words = F.filter(F.split(v, " "), lambda w: w != "")
    out = F.when(F.size(words) > 40, F.concat(F.array_join(F.slice(words, 1, 40), " "), F.lit("...")))\
        .otherwise(v)
    return F.when(T.trim_ws(v) == "", F.lit(None)).otherwise(out)


def iso8601(ts: Column) -> Column:
    """ISO-8601 with offset, in UTC (session time zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def taxonomy_terms(terms: DataFrame, include_taxonomy: Column | None = None) -> DataFrame:
    """(page_id, tax: ARRAY<STRUCT<key, vals>>): public taxonomies (plus a rule
    hook), names distinct in first-seen order, key 'taxonomy_' + yaml_key(name),
    empty lists skipped.  Taxonomies ordered by name."""
    t = terms.filter(F.col("is_public"))
    if include_taxonomy is not None:
        t = t.filter(include_taxonomy)
    per_tax = (t.groupBy("page_id", "taxonomy")
               .agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))),
                                                 lambda x: x["name"])).alias("vals"))
               .filter(F.size("vals") > 0))
    per_tax = per_tax.withColumn("key", F.concat(F.lit("taxonomy_"), T.yaml_key(F.col("taxonomy"))))
    return per_tax.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("taxonomy", "key", "vals"))), lambda x: F.struct(x["key"].alias("key"), x["vals"].alias("vals"))
    ).alias("tax"))


def _entry(key: str, val: Column, is_list: bool = False) -> Column:
    vals = val if is_list else F.array(val)
    return F.struct(F.lit(key).alias("key"), F.lit(is_list).alias("is_list"), vals.alias("vals"))


def front_matter(meta: DataFrame, pages: DataFrame, terms: DataFrame | None = None,
                 include_taxonomy: Column | None = None) -> DataFrame:
    """(page_id, site_id, url, markdown_url, fm: ARRAY<STRUCT<key, is_list, vals>>)
    in output order: title, id, type, slug, published_at, modified_at, url,
    markdown_url, excerpt (if any), taxonomies."""
    return front_matter_rows(meta.join(pages.select("page_id", "url"), "page_id"), terms, include_taxonomy)


def front_matter_rows(m: DataFrame, terms: DataFrame | None = None,
                      include_taxonomy: Column | None = None, partitions: int | None = None) -> DataFrame:
    """front_matter over rows that already hold the metadata and the page URL.  With
    `partitions`, terms are hash-partitioned by page_id into the same number of
    partitions as `m`, so the taxonomy join and later page_id joins need no
    further exchange."""
    m = m.withColumn("ex_raw", excerpt_source(F.col("excerpt"), F.col("content")))
    m = m.select("page_id", "site_id", "type", "slug", "title", "ex_raw", "url", "published_at", "modified_at")
    m = decode_entities(m, "page_id", ["title", "ex_raw"])
    m = m.withColumn("markdown_url", markdown_url(F.col("url")))
    ex = excerpt_finish(F.col("ex_raw"))
    base = F.array(
        _entry("title", F.coalesce(F.col("title"), F.lit(""))),
        _entry("id", F.col("page_id").cast("string")),
        _entry("type", F.coalesce(F.col("type"), F.lit(""))),
        _entry("slug", F.coalesce(F.col("slug"), F.lit(""))),
        _entry("published_at", F.coalesce(iso8601(F.col("published_at")), F.lit(""))),
        _entry("modified_at", F.coalesce(iso8601(F.col("modified_at")), F.lit(""))),
        _entry("url", F.col("url")),
        _entry("markdown_url", F.col("markdown_url")))
    fm = F.when(ex.isNotNull(), F.concat(base, F.array(_entry("excerpt", ex)))).otherwise(base)
    m = m.withColumn("fm", fm)
    if terms is not None:
        if partitions:
            terms = terms.repartition(partitions, "page_id")
        tx = taxonomy_terms(terms, include_taxonomy)
        m = m.join(tx, "page_id", "left")
        m = m.withColumn("fm", F.concat("fm", F.coalesce(F.transform("tax", lambda x: F.struct(
            x["key"].alias("key"), F.lit(True).alias("is_list"), x["vals"].alias("vals"))),
            F.array().cast("array<struct<key:string,is_list:boolean,vals:array<string>>>"))))
    return m.select("page_id", "site_id", "url", "markdown_url", "fm")


def yaml_block(fm: Column) -> Column:
    """`key: "v"` lines, or `key:` then `  - "v"` lines; keys normalised, empty keys
    dropped; ends with a newline."""
    entries = F.filter(F.transform(fm, lambda e: F.struct(T.yaml_key(e["key"]).alias("k"), e["is_list"].alias("l"),
                                                          e["vals"].alias("v"))), lambda e: e["k"] != "")
    lines = F.transform(entries, lambda e: F.when(
        e["l"], F.concat(e["k"], F.lit(":"), F.coalesce(F.concat(F.lit("\n"), F.array_join(
            F.transform(e["v"], lambda v: F.concat(F.lit("  - "), T.yaml_scalar(v))), "\n")), F.lit(""))))
        .otherwise(F.concat(e["k"], F.lit(": "), T.yaml_scalar(F.try_element_at(e["v"], F.lit(1))))))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def assemble_document(yaml: Column, body: Column) -> Column:
    return F.concat(F.lit("---\n"), yaml, F.lit("---\n\n"), T.trim_ws(body), F.lit("\n"))


def alternate_link(markdown_url_col: Column) -> Column:
    """`<link rel="alternate" type="text/markdown" ...>` for a servable page."""
    href = F.replace(F.replace(F.replace(markdown_url_col, F.lit("&"), F.lit("&#038;")), F.lit('"'), F.lit("&quot;")),
                     F.lit("'"), F.lit("&#039;"))
    return F.concat(F.lit('<link rel="alternate" type="text/markdown" title="Markdown version" href="'),
                    href, F.lit('" />'))
