"""HTML -> ordered token rows.  Replaces a DOM load: one regex pass per page
(`regexp_extract_all` + `posexplode`), JVM-side, lossless (token lengths sum to
`length(html)`).  Everything later is windows and aggregates keyed by page_id, so
the pages are hash-partitioned by page_id once, before exploding; `Generate`
keeps that partitioning and no later step shuffles tokens again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Token pattern, alternatives in priority order: comment, raw script/style element,
# tag (possessive quantifiers: a tag with tens of thousands of attributes must not
# overflow the regex stack), declaration / processing instruction, character
# reference, text run, lone '<' or '&'.
#
# Linear on any input: where an end is missing, the search for it ran to the end of the page, and
# the token takes what was searched.  A comment or raw element without an end hides the rest
# of the page; a tag or declaration without one is text (_split_tail).  A quote that nothing closes is
# an ordinary character of its tag.
_MARKUP_RX = (
    r"(?i)<!--(?>-?>|[\s\S]*?-->|[\s\S]*+)"
    r"|<script(?=[\s/>])[^>]*+>(?>[\s\S]*?</script\s*+>|[\s\S]*+)"
    r"|<style(?=[\s/>])[^>]*+>(?>[\s\S]*?</style\s*+>|[\s\S]*+)"
    r"|</?[a-z][^\s/>]*+(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+(?:>|\z)"
    r"|<[!?][^>]*+(?:>|\z)"
)
_REFERENCE_RX = r"&(?:#[0-9]++|#x[0-9a-f]++|[a-z][a-z0-9]{0,31});"
_TEXT_RX = _REFERENCE_RX + r"|[^<&]++|[<&]"
TOKEN_RX = _MARKUP_RX + "|" + _TEXT_RX
# The same with a text and the references in it as one token.
_RUN_RX = r"[^<]++|<"
RUNS_RX = _MARKUP_RX + "|" + _RUN_RX
_RAW_RX = r"(?i)^<(?:script|style)(?=[\s/>])[^>]*+>"

# Elements that never have content.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
             "meta", "param", "source", "track", "wbr"]

# Attribute pattern: name, optional = value (double, single or unquoted).
ATTR_RX = r"""([^\s"'>/=]+)(?:\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?"""


def _split_tail(found: Column, text_rx: str = "(?i)" + _TEXT_RX) -> Column:
    """The tokens of a page, with a last one that is an unclosed tag or declaration read as text."""
    last = F.try_element_at(found, F.lit(-1))
    opened = last.rlike(r"^<[!?/A-Za-z]") & ~last.endswith(">") & ~last.startswith("<!--") & ~last.rlike(_RAW_RX)
    return F.when(opened, F.concat(F.slice(found, 1, F.size(found) - 1), F.regexp_extract_all(last, F.lit(text_rx), 0))).otherwise(found)


def _kind(tok: Column) -> Column:
    # By the first characters where these decide; most tokens need no pattern.
    raw = F.lower(F.substring(tok, 2, 5)).isin("scrip", "style")
    return (F.when(~tok.startswith("<") & ~tok.startswith("&"), F.lit("text"))
            .when(tok.startswith("&"), F.when(tok.rlike(r"^&.+;$"), F.lit("entity")).otherwise(F.lit("text")))
            .when(tok.startswith("<!--"), F.lit("comment"))
            .when(raw & tok.rlike(_RAW_RX), F.lit("raw"))
            .when(tok.startswith("</"), F.when(tok.rlike(r"^</[A-Za-z]"), F.lit("close")).otherwise(F.lit("text")))
            .when(tok.rlike(r"^<[A-Za-z]"), F.lit("open"))
            .when(tok.rlike(r"^<[!?]"), F.lit("decl"))
            .otherwise(F.lit("text")))


def _key_is(key: str):
    return lambda p: p["k"] == key


# The attributes the conversion reads.
ATTR_KEYS = ["id", "class", "href", "src", "data-src", "data-lazy-src", "data-original", "alt", "title"]


def tag_attributes(tok: Column) -> Column:
    """MAP<name, value> of the attributes the conversion reads (ATTR_KEYS) for an
    open tag: names lower-cased, first occurrence wins, character references decoded
    once.  Linear in the number of
    attributes (one pass to split, one filter per key), so a tag with tens of
    thousands of attributes stays cheap."""
    body = F.regexp_replace(tok, r"^<[A-Za-z][^\s/>]*+|/?>$", "")
    parts = F.regexp_extract_all(body, F.lit(ATTR_RX), 0)
    pairs = F.transform(parts, lambda a: F.struct(
        T.ascii_lower(F.regexp_extract(a, r"^([^\s=]+)", 1)).alias("k"), a.alias("a")))
    raws = []
    for key in ATTR_KEYS:
        first = F.try_element_at(F.filter(pairs, _key_is(key)), F.lit(1))["a"]
        raws.append(F.regexp_extract(first, r"(?s)^[^\s=]+\s*=\s*(.*)$", 1))
    unquoted = F.transform(F.array(*raws), lambda r: T.decode_references(F.regexp_replace(r, r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2")))
    return F.map_from_arrays(F.lit(ATTR_KEYS), unquoted)


def bare_tag() -> Column:
    """Over open tags: nothing stands between the name and the '>'."""
    return (F.length("tok") == F.length("tag") + 2) & F.col("tok").endswith(">")


def no_attributes() -> Column:
    return F.map_from_arrays(F.lit(ATTR_KEYS), F.array_repeat(F.lit(None).cast("string"), len(ATTR_KEYS)))


#: Characters of HTML in a task of the page_id exchange.  Structure keeps some ten sorted copies of a
#: task's token rows, so this bounds a task's memory, and none spills however large the input is.
TASK_CHARS = 1 << 21


def page_partitions(pages: DataFrame, partitions: int | None = None) -> int:
    """Number of tasks for the page_id exchange: the job's setting, else the session's, or more where the
    pages have more than TASK_CHARS for each (one aggregate over them)."""
    if partitions:
        return partitions
    least = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if pages.isStreaming:
        return least
    chars = pages.agg(F.sum(F.length("html"))).first()[0] or 0
    return max(least, -(-chars // TASK_CHARS))


def page_tokens(pages: DataFrame, partitioned: bool = False, partitions: int | None = None, runs: bool = False) -> DataFrame:
    """(page_id, pos, tok, kind, tag, is_void, attrs, text).

    `kind`: comment | raw | open | close | decl | entity | text.  `text` is the
    decoded character data for text and entity tokens (NULL otherwise).  With `runs`, the text
    between two tags is one token whatever references it holds (entity if it holds any), so
    a page has about as many rows as markup, and nothing is joined.  Pass
    `partitioned=True` when `pages` is already hash-partitioned by page_id (for
    instance the output of a join on page_id)."""
    spark = pages.sparkSession
    if not partitioned:
        pages = pages.repartition(page_partitions(pages, partitions), "page_id")
    # The array is made before it is looked at, so that the pattern runs once a page.
    found = pages.select("page_id", F.regexp_extract_all(F.col("html"), F.lit(RUNS_RX if runs else TOKEN_RX), 0).alias("found"))
    split = (lambda a: _split_tail(a, _RUN_RX)) if runs else (lambda a: _split_tail(a))
    toks = found.select("page_id", F.posexplode(F.get(F.transform(F.array("found"), split), F.lit(0))).alias("pos", "tok"))
    kind = _kind(F.col("tok"))
    if runs:
        refers = F.col("tok").contains("&") & F.col("tok").rlike("(?i)" + _REFERENCE_RX)
        kind = F.when(F.col("tok").startswith("<"), kind).when(refers, F.lit("entity")).otherwise(F.lit("text"))
    toks = toks.withColumn("kind", kind)
    tag = T.ascii_lower(F.regexp_extract("tok", r"^</?([A-Za-z][^\s/>]*)", 1))
    toks = toks.withColumn("tag", F.when(T.among("kind", ["open", "close", "raw"]), tag))
    toks = toks.withColumn("is_void", (F.col("kind") == "open") & (
        T.among("tag", VOID_TAGS) | F.col("tok").endswith("/>")))
    toks = toks.withColumn("attrs", F.when(F.col("kind") == "open", F.when(bare_tag(), no_attributes()).otherwise(tag_attributes(F.col("tok")))))
    if runs:
        return toks.withColumn("text", F.when(F.col("kind") == "text", F.col("tok")).when(F.col("kind") == "entity", T.decode_references(F.col("tok"))))
    # Character references: numeric ones by arithmetic, named ones through a
    # broadcast lookup of the bounded HTML5 table.
    entities = T.entity_table(spark)
    key = F.when(F.col("kind") == "entity", F.regexp_extract("tok", r"^&([A-Za-z][A-Za-z0-9]*);$", 1))
    toks = toks.withColumn("ent_key", key)
    toks = toks.join(F.broadcast(entities), toks["ent_key"] == entities["ent_name"], "left")
    text = (F.when(F.col("kind") == "text", F.col("tok"))
            .when(F.col("kind") == "entity",
                  F.coalesce(F.col("ent_chars"), T.numeric_entity(F.col("tok")), F.col("tok"))))
    return toks.withColumn("text", text).drop("ent_key", "ent_name", "ent_chars")


def plain_text(tokens: DataFrame) -> DataFrame:
    """No-DOM fallback: drop tags, comments, script and style; decode; whitespace
    runs -> one space; CR normalised; 3+ newlines -> 2; trimmed.  (page_id, text)."""
    # Whitespace is collapsed before decoding, so whitespace produced by a character
    # reference is marked while runs are collapsed; the text's own mark characters are shielded.
    space, marked = "\n\t \r", T.MARKS[:4]
    t = tokens.filter(T.among("kind", ["text", "entity"]))
    own = T.shield("text")
    piece = F.when(F.col("kind") == "entity", F.translate(own, space, marked)).otherwise(own)
    agg = t.groupBy("page_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", piece.alias("s")))), lambda x: x["s"]), "").alias("raw"))
    v = T.trim_ws(F.regexp_replace(F.col("raw"), r"[\r\n\t ]+", " "))
    v = T.unshield(F.translate(v, marked, space))
    v = F.regexp_replace(v, r"\r\n?", "\n")
    v = F.regexp_replace(v, r"\n{3,}", "\n\n")
    return agg.select("page_id", T.trim_ws(v).alias("text"))
