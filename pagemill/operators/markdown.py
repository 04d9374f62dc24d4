"""Markdown from content tokens, with no recursive walk and no branching plan.

Each content token is assigned to a *unit* by running windows:

* a table cell (the cell at table depth 1; rows and tables are further ordered
  aggregations of cells),
* a `pre` block (outermost `pre`),
* a list item (the last one opened, where the innermost container is a list),
* a rule (`hr`),
* a container's own open tag (block quote, list): it renders nothing, but says where blocks are,
* otherwise a segment: the run of tokens since the last block-boundary tag.

Every token emits a piece (text, emphasis sentinels, line-break sentinel, image
Markdown).  Links and inline code are flattened spans.  The plan is one linear chain
of aggregations, all keyed by page_id (so the single page_id exchange before
tokenizing serves every step and nothing is computed twice):

    tokens -> (span | run) -> unit -> block -> page

String rules finish each level.  A block's lines are prefixed by its container path, the quotes and
lists around it from the outside in, and the separator between two blocks comes from the
previous non-empty block (running `last` window) and the path both share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..session import ship
from .nodes import BIG, BLOCK_TAGS, CELL_TAGS, LIST_TAGS, TABLE_SECTION_TAGS, before, nest_depths, running, whole

# Characters of T.MARKS; texts that hold them are shielded first and restored block by block.
MARK, BR, LNL = "\ue001", "\ue002", "\ue003"
EMPH = {"b": ("\ue010", "\ue011", "**"), "i": ("\ue012", "\ue013", "*"), "d": ("\ue014", "\ue015", "~~")}
EMPH_TAGS = {"b": ["b", "strong"], "i": ["i", "em"], "d": ["del", "s", "strike"]}
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
SPAN_TAGS = ["a", "code"]
CONTAINERS = ["blockquote"] + LIST_TAGS
# Characters that count as whitespace next to an emphasis sentinel.
_EDGE = rf"(?:(?U)\s|[{MARK}{BR}{LNL}])+"


def _opn(tags) -> Column:
    return (F.col("kind") == "open") & T.among("tag", tags)


def _cls(tags) -> Column:
    return (F.col("kind") == "close") & T.among("tag", tags)


def _ordered(key: str, val: Column, sep: str = "") -> Column:
    """Concatenate `val` in `key` order within an aggregation group."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), val.alias("v")))),
                                    lambda x: x["v"]), sep)


def image_source(attrs: Column) -> Column:
    """First non-blank of src, data-src, data-lazy-src, data-original ('' if none)."""
    cands = [T.trim_ws(F.coalesce(attrs.getItem(k), F.lit(""))) for k in
             ("src", "data-src", "data-lazy-src", "data-original")]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cands], F.lit(""))


def image_url_ok(src: Column) -> Column:
    """Relative URLs and http(s) are kept; any other scheme (data:, javascript:...)
    drops the image."""
    scheme = F.regexp_extract(src, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    return (src != "") & ((scheme == "") | T.ascii_lower(scheme).isin("http", "https"))


def image_markdown(attrs: Column) -> Column:
    """`![alt](src "title")`; alt defaults to 'Image'; '' when no usable source."""
    src = image_source(attrs)
    alt = T.normalize_inline(F.coalesce(attrs.getItem("alt"), F.lit("")))
    alt = F.when(alt == "", F.lit("Image")).otherwise(alt)
    title = T.image_title_escape(T.normalize_inline(F.coalesce(attrs.getItem("title"), F.lit(""))))
    body = F.concat(F.lit("!["), T.image_text_escape(alt), F.lit("]("), src)
    md = F.when(title != "", F.concat(body, F.lit(' "'), title, F.lit('")'))).otherwise(F.concat(body, F.lit(")")))
    return F.when(image_url_ok(src), md).otherwise(F.lit(""))


def _last_struct(cond: Column, fields: dict, w: Window) -> Column:
    return F.last(F.when(cond, F.struct(*[v.alias(k) for k, v in fields.items()])), ignorenulls=True).over(w)


def assign_units(content: DataFrame) -> DataFrame:
    """Context depths and unit keys (ukind, uid) for every content token."""
    w = running(Window.partitionBy("page_id").orderBy("pos"))
    # Elements that render nothing, with their content; does the page have any
    # non-blank content at all (blank extraction = failure)?
    nonblank = ~((F.col("kind") == "text") & (F.regexp_replace("text", r"[ \t\n\r\x00\x0B]", "") == ""))
    df = content.withColumns({
        "_drop": F.coalesce(F.max(F.when(_opn(["iframe"]), F.col("hi"))).over(w) >= F.col("pos"), F.lit(False)),
        # Inside a link or code span: flattened to text, so tags there structure nothing.
        "_flat": F.coalesce(F.max(F.when(_opn(SPAN_TAGS), F.col("hi"))).over(before(Window.partitionBy("page_id").orderBy("pos"))) > F.col("pos"), F.lit(False)),
        "has_content": F.max(nonblank).over(whole(Window.partitionBy("page_id").orderBy("pos")))})
    df = df.filter(~F.col("_drop") & ~T.among("kind", ["raw", "decl"])).drop("_drop")
    df = df.withColumn("kind", F.when(F.col("_flat") & T.among("kind", ["open", "close"]), F.lit("flat")).otherwise(F.col("kind")))
    df = nest_depths(df, {"k_d": (_opn(CONTAINERS), _cls(CONTAINERS)),
                          "l_d": (_opn(LIST_TAGS), _cls(LIST_TAGS)),
                          "t_d": (_opn(["table"]), _cls(["table"])),
                          "pre_d": (_opn(["pre"]), _cls(["pre"])),
                          # Emphasis that has its close, over whatever blocks it holds.
                          **{f"_m{k}": (_opn(t) & F.col("closed"), _cls(t)) for k, t in EMPH_TAGS.items()}})
    boundary = T.among("kind", ["open", "close"]) & T.among("tag", BLOCK_TAGS)
    top = F.col("t_d") == 1
    df = df.withColumns({
        "_seg": _last_struct(boundary, {"pos": F.col("pos"), "kind": F.col("kind"), "tag": F.col("tag")}, w),
        "_pre": F.last(F.when(_opn(["pre"]) & (F.col("pre_d") == 1), F.col("pos")), ignorenulls=True).over(w),
        "_tbl": F.last(F.when(_opn(["table"]) & top, F.col("pos")), ignorenulls=True).over(w),
        "_row": _last_struct(top & T.among("tag", ["tr", "table"] + TABLE_SECTION_TAGS)
                             & T.among("kind", ["open", "close"]), {"pos": F.col("pos"), "on": _opn(["tr"])}, w),
        "_cell": _last_struct(top & T.among("tag", ["tr", "table"] + CELL_TAGS + TABLE_SECTION_TAGS)
                              & T.among("kind", ["open", "close"]), {"pos": F.col("pos"), "on": _opn(CELL_TAGS)}, w),
        "root_list": F.last(F.when(_opn(LIST_TAGS) & (F.col("l_d") == 1), F.col("pos")), ignorenulls=True).over(w)})
    # The innermost container, and its items if it is a list: events at the token's own depth.
    wl = running(Window.partitionBy("page_id", "k_d").orderBy("pos"))
    li_ev = T.among("kind", ["open", "close"]) & T.among("tag", ["li"] + CONTAINERS)
    df = df.withColumns({
        "_item": _last_struct(li_ev, {"pos": F.col("pos"), "on": _opn(["li"])}, wl),
        "_nli": F.sum(F.when(_opn(["li"]), 1).otherwise(0)).over(wl),
        "_box": _last_struct(_opn(CONTAINERS), {"pos": F.col("pos"), "ol": F.col("tag") == "ol", "list": T.among("tag", LIST_TAGS)}, wl)})
    df = df.withColumn("_list0", F.last(F.when(_opn(CONTAINERS), F.col("_nli")), ignorenulls=True).over(wl))
    in_list = (F.col("k_d") >= 1) & F.coalesce(F.col("_box.list"), F.lit(False))
    ukind = (F.when(F.col("t_d") >= 1, F.lit("cell")).when(F.col("pre_d") >= 1, F.lit("pre")).when(_opn(CONTAINERS), F.lit("box"))
             .when(in_list, F.lit("item")).when(_opn(["hr"]), F.lit("hr")).otherwise(F.lit("seg")))
    df = df.withColumn("ukind", ukind)
    uid = (F.when(F.col("ukind") == "cell", F.when(F.col("_cell.on") & F.col("_row.on"), F.col("_cell.pos")))
           .when(F.col("ukind") == "pre", F.col("_pre"))
           .when(T.among("ukind", ["box", "hr"]), F.col("pos"))
           .when(F.col("ukind") == "item", F.when(F.col("_item.on"), F.col("_item.pos")))
           .otherwise(F.coalesce(F.col("_seg.pos"), F.lit(-1))))
    heading = F.when((F.col("_seg.kind") == "open") & T.among("_seg.tag", HEADINGS),
                     F.substring(F.col("_seg.tag"), 2, 1).cast("int"))
    df = df.withColumns({"uid": uid, "level": F.when(F.col("ukind") == "seg", heading),
                         "list_id": F.col("_box.pos"), "ordered": F.col("_box.ol"), "in_list": in_list,
                         "idx": F.col("_nli") - F.col("_list0"),
                         "row_id": F.col("_row.pos"), "tbl_id": F.col("_tbl")})
    return df.filter(F.col("uid").isNotNull()).drop(
        "_seg", "_pre", "_tbl", "_row", "_cell", "_item", "_nli", "_box", "_list0",
        "k_d_stray", "l_d_stray", "t_d_stray", "pre_d_stray", "_flat")


def token_pieces(units: DataFrame, cfg: Config) -> DataFrame:
    """Per token: its piece and its group `g` within the unit (a flattened span, or a
    run of tokens between spans), plus emphasis bookkeeping.  One sort:
    (page_id, ukind, uid, pos)."""
    wu = Window.partitionBy("page_id", "ukind", "uid").orderBy("pos")
    inl = T.among("ukind", ["seg", "item"])
    span_open = inl & _opn(SPAN_TAGS)
    span = F.when(span_open, F.struct(F.col("hi").alias("h"), (-F.col("pos")).alias("nlo"), F.col("tag").alias("t"),
                                      F.col("attrs").getItem("href").alias("href")))
    # The span that reaches furthest, at the token and at the one before: one pass gives both.
    df = units.withColumn("_own", span)
    df = df.withColumns({"_before": F.max("_own").over(before(wu)), "_prev": F.lag("pos").over(wu)})
    df = df.withColumn("_sp", F.greatest("_before", "_own"))
    df = df.withColumn("in_span", F.coalesce(F.col("_sp.h") >= F.col("pos"), F.lit(False)))
    start = F.col("in_span") | F.col("_prev").isNull() | F.coalesce(F.col("_before.h") >= F.col("_prev"), F.lit(False))
    df = df.withColumn("_start", F.when(F.col("in_span"), -F.col("_sp.nlo")).when(start, F.col("pos"))).drop("_own", "_before", "_prev")
    df = df.withColumn("g", F.last("_start", ignorenulls=True).over(running(wu)))
    # Pieces.  (The image is a column of its own, as shield() names what it is given more than once.)
    if cfg.include_images:
        df = df.withColumn("_img", F.when(_opn(["img"]), image_markdown(F.col("attrs"))))
    text = T.shield("text")
    level_prefix = F.concat(F.lit(MARK), F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "))
    piece = F.when(T.among("kind", ["text", "entity"]), text)
    for k, tags in EMPH_TAGS.items():
        o, c, _ = EMPH[k]
        piece = piece.when(_opn(tags), F.lit(o)).when(_cls(tags) & ~F.col(f"_m{k}_stray"), F.lit(c))
    piece = piece.when(_opn(["br"]), F.lit(BR))
    piece = piece.when(_opn(["img"]), T.shield("_img") if cfg.include_images else F.lit(""))
    # Inside a list item, blocks are flattened onto the item's line.
    in_item = F.col("ukind") == "item"
    piece = piece.when(in_item & _opn(HEADINGS), level_prefix)
    piece = piece.when(in_item & _opn(["hr"]), F.lit(MARK + " --- "))
    piece = piece.when(in_item & T.among("kind", ["open", "close"]) & T.among("tag", BLOCK_TAGS),
                       F.lit(MARK + " "))
    piece = piece.otherwise(F.lit(MARK))
    piece = (F.when(T.among("ukind", ["cell", "pre"]) | F.col("in_span"), F.coalesce(text, F.lit("")))
             .when(F.col("ukind") == "hr", F.lit("---")).otherwise(piece))
    eff = {f"e{k}": F.when(_opn(t) & inl & ~F.col("in_span"), 1)
           .when(_cls(t) & inl & ~F.col("in_span") & ~F.col(f"_m{k}_stray"), -1).otherwise(0)
           for k, t in EMPH_TAGS.items()}
    # Emphasis open before a token: at a unit's first token, what earlier blocks carry over.
    carry = {f"c{k}": F.col(f"_m{k}") - F.when(_opn(t) & F.col("closed"), 1).otherwise(0) for k, t in EMPH_TAGS.items()}
    return df.withColumns({"piece": piece, **eff, **carry})


def finish_inline(s: Column) -> Column:
    """Unit string with sentinels -> Markdown: whitespace runs collapsed (marks keep
    text nodes apart), emphasis trimmed inside and dropped when empty, sentinels
    replaced, trimmed."""
    v = F.regexp_replace(s, r"(?U)\s+", " ")
    opens = "".join(o for o, _, _ in EMPH.values())
    closes = "".join(c for _, c, _ in EMPH.values())
    v = F.regexp_replace(v, rf"([{opens}]){_EDGE}", "$1")
    v = F.regexp_replace(v, rf"{_EDGE}([{closes}])", "$1")
    v = drop_empty_emphasis(v)
    for o, c, m in EMPH.values():
        v = F.replace(F.replace(v, F.lit(o), F.lit(m)), F.lit(c), F.lit(m))
    v = F.replace(F.replace(F.replace(v, F.lit(BR), F.lit("  \n")), F.lit(LNL), F.lit("\n")), F.lit(MARK), F.lit(""))
    return T.trim_ws(v)


def drop_empty_emphasis(v: Column) -> Column:
    """Emphasis with nothing inside removed, however deeply it is nested: in each run of
    sentinels, a close takes away the open of its kind that comes just before it."""
    empty = "|".join(o + f"[{MARK}]*" + c for o, c, _ in EMPH.values())
    marks = MARK + "".join(o + c for o, c, _ in EMPH.values())

    def step(acc: Column, ch: Column) -> Column:
        bare = F.regexp_replace(acc, f"[{MARK}]+$", "")
        out = F.concat(acc, ch)
        for o, c, _ in EMPH.values():
            out = F.when((ch == c) & bare.endswith(o), F.left(bare, F.length(bare) - 1)).otherwise(out)
        return out

    def reduced(run: Column) -> Column:
        return F.when(run.rlike(empty), F.aggregate(F.split(run, ""), F.lit(""), step)).otherwise(run)
    runs = F.regexp_extract_all(v, F.lit(f"[{marks}]+|[^{marks}]+"), 0)
    return F.when(v.rlike(empty), F.array_join(F.transform(runs, reduced), "")).otherwise(v)


def cleanup_lines(c: Column) -> Column:
    """The line rules, then the outer white space trimmed."""
    return T.trim_ws(line_rules(c))


def line_rules(c: Column) -> Column:
    """Leading whitespace before a heading marker removed; one leading whitespace
    character before a list marker removed; 3+ newlines -> 2."""
    # The patterns of the line rules.
    v = F.regexp_replace(c, r"\r\n?", "\n")
    v = F.regexp_replace(v, r"(?mU)^[^\S\n]+(#{1,6}[^\S\n]+)", "$1")
    v = F.regexp_replace(v, r"(?mU)^[^\S\n]([-*+][^\S\n]|\d+\.[^\S\n])", "$1")
    return F.regexp_replace(v, r"\n{3,}", "\n\n")


def blank_prefix(prefix: Column) -> Column:
    """What a blank line within containers of this prefix holds: each quote trims the lines inside it
    and adds '> ', each list indents but blank lines."""
    outer = F.regexp_extract(prefix, "^ *> ", 0)
    return F.concat(outer, F.rtrim(F.substr(prefix, F.length(outer) + 1)))


def prefix_lines(text: Column, prefix: Column) -> Column:
    """`prefix` before every line; in a quote, lines are right-trimmed first."""
    lines = F.when(prefix.contains(">"), F.regexp_replace(text, r"(?md)[ \t\x0B\x00\r]+$", "")).otherwise(text)
    full = F.regexp_replace(lines, F.lit(r"(?md)^(?=[^\n])"), prefix)
    return F.when(prefix == "", text).otherwise(F.regexp_replace(full, F.lit("(?md)^$"), blank_prefix(prefix)))


def _first(c: str) -> Column:
    return F.first(c, ignorenulls=True)


# Metadata carried up the aggregation chain: column -> how groups combine it.
_META = {"k_d": F.min, "l_d": F.min, "level": _first, "list_id": _first, "ordered": _first, "in_list": _first, "idx": F.max,
         "root_list": _first, "row_id": _first, "tbl_id": _first, "has_content": F.max}


def _meta_aggs() -> list[Column]:
    return [f(c).alias(c) for c, f in _META.items()]


def table_rows(cells: Column) -> Column:
    """Cells (rkey, uid, text), in order, -> rows of cell strings.  Cells have none of T.MARKS, so two of
    them mark where rows and cells begin, and the string is cut there: linear in the cells."""
    def joined(cs: Column) -> Column:
        def begun(c: Column, i: Column) -> Column:
            return F.concat(F.when(i == 0, F.lit("")).when(F.get(cs, i - 1)["rkey"].eqNullSafe(c["rkey"]), F.lit(BR)).otherwise(F.lit(LNL)), c["text"])
        return F.array_join(F.transform(cs, begun), "")
    # In a transform of its own, so that the sorted cells are made once.
    line = F.get(F.transform(F.array(cells), joined), F.lit(0))
    return F.transform(F.split(line, LNL), lambda r: F.split(r, BR))


def table_markdown(rows: Column) -> Column:
    """Rows of cell strings -> Markdown table: first row is the header, rows padded
    to the widest, `---` separator."""
    ncol = F.array_max(F.transform(rows, lambda r: F.size(r)))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), ncol - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    sep = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), ncol), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.try_element_at(padded, F.lit(1))), sep),
                                 F.transform(F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0))), line)), "\n")


def markdown_blocks(content: DataFrame, cfg: Config) -> DataFrame:
    """block_rows(), a page at a time: the tokens of a page are gathered, and its blocks made in one pass (page.py)."""
    from . import page as P
    ship(content.sparkSession)
    images = cfg.include_images

    @F.arrow_udf(f"array<struct<{P.BLOCK}>>")
    def made(pages: pa.Array) -> pa.Array:
        return P.some_by_some(lambda some: P.block_lists(some, images), pages)
    whole = content.groupBy("page_id").agg(F.collect_list(F.struct(*P.CONTENT)).alias("tokens"))
    return whole.select("page_id", made("tokens").alias("_b")).select("page_id", F.explode("_b").alias("_b")).select("page_id", "_b.*")


def block_rows(content: DataFrame, cfg: Config) -> DataFrame:
    """(page_id, upos, sub, bkind, text, k_d, l_d, list_id, root_list, ordered, in_list, has_content):
    one row per block in document order by (upos, sub); `text` '' renders nothing.  Rows of
    bkind 'box' are the containers (k_d counts them themselves)."""
    pieces = token_pieces(assign_units(content), cfg)
    # Level 1: flattened spans and runs.
    g1 = pieces.groupBy("page_id", "ukind", "uid", "g").agg(
        _ordered("pos", F.col("piece")).alias("s"), F.max("in_span").alias("is_span"),
        F.first(F.when(F.col("pos") == F.col("g"), F.col("_sp")), ignorenulls=True).alias("sp"),
        *[F.sum(f"e{k}").alias(f"e{k}") for k in EMPH], F.min_by(F.struct(*[f"c{k}" for k in EMPH]), "pos").alias("carry"), *_meta_aggs())
    link_text = T.normalize_inline(F.col("s"))
    g1 = g1.withColumn("href", T.trim_ws(F.coalesce(F.col("sp.href"), F.lit(""))))
    href = T.shield("href")
    link = (F.when(href == "", link_text)
            .otherwise(F.concat(F.lit("["), F.when(link_text == "", href).otherwise(link_text),
                                F.lit("]("), href, F.lit(")"), F.lit(LNL))))
    code = T.inline_code(F.col("s"))
    g1 = g1.withColumn("s", F.when(F.col("is_span") & (F.col("sp.t") == "a"), link)
                       .when(F.col("is_span"), code).otherwise(F.col("s")))
    # Level 2: units.
    u = g1.groupBy("page_id", "ukind", "uid").agg(
        _ordered("g", F.col("s")).alias("s"), *[F.sum(f"e{k}").alias(f"e{k}") for k in EMPH],
        F.min_by("carry", "g").alias("carry"), *_meta_aggs())
    openers = F.concat(*[F.repeat(F.lit(EMPH[k][0]), F.col(f"carry.c{k}").cast("int")) for k in ("b", "i", "d")])
    closers = F.concat(*[F.repeat(F.lit(EMPH[k][1]), F.greatest(F.col(f"e{k}") + F.col(f"carry.c{k}"), F.lit(0)).cast("int")) for k in ("d", "i", "b")])
    t = finish_inline(F.concat(openers, "s", closers))
    heading = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), T.collapse_ws(t))
    marker = F.when(F.col("ordered"), F.concat(F.col("idx").cast("string"), F.lit(". "))).otherwise(F.lit("- "))
    item = F.concat(marker, T.collapse_ws(t))
    kind = F.col("ukind")
    text = (F.when(kind == "cell", T.table_cell_escape(T.normalize_inline(F.col("s"))))
            .when(kind == "pre", T.fenced_code(T.normalize_code_block(F.col("s"))))
            .when(kind == "hr", F.lit("---")).when(kind == "box", F.lit(""))
            .when(kind == "item", line_rules(item))
            .when(t == "", F.lit(""))
            .when(F.col("level").isNotNull(), line_rules(heading))
            .otherwise(line_rules(t)))
    u = u.withColumns({"text": text,
                       "bkind": F.when(kind == "cell", "table").when(kind == "pre", "code").when(kind == "hr", "rule")
                       .when(kind.isin("box", "item"), kind).when(F.col("level").isNotNull(), "heading").otherwise("para"),
                       "bkey": F.when(kind == "cell", F.col("tbl_id")).otherwise(F.col("uid")),
                       "rkey": F.when(kind == "cell", F.col("row_id")).otherwise(F.lit(0))})
    # Level 3: blocks.
    b = u.groupBy("page_id", "bkind", "bkey").agg(
        F.array_sort(F.collect_list(F.struct("rkey", "uid", "text"))).alias("cells"), *_meta_aggs())
    btext = F.when(F.col("bkind") == "table", table_markdown(table_rows(F.col("cells")))) \
        .otherwise(F.try_element_at("cells", F.lit(1))["text"])
    b = b.withColumn("text", F.coalesce(btext, F.lit("")))
    return b.select("page_id", F.col("bkey").alias("upos"),
                    F.when(T.among("bkind", ["rule", "box"]), 0).otherwise(1).alias("sub"), "bkind",
                    T.unshield("text").alias("text"), F.coalesce("k_d", F.lit(0)).alias("k_d"),
                    F.coalesce("l_d", F.lit(0)).alias("l_d"), "list_id", "root_list", "ordered", "in_list", "has_content")


def container_paths(blocks: DataFrame) -> DataFrame:
    """The blocks with `keep` (it renders something) and `path`: ARRAY<STRUCT<id, quote>>, the
    containers around a block from the outside in (of an item, without its own list).

    A block at depth n looks for the container opened last at each depth up to n; depths are
    dealt to rows, so the work is that of writing the prefixes."""
    none = F.lit(None).cast("struct<id: int, quote: boolean>")
    here = F.struct(F.col("upos").cast("int").alias("id"), (~F.col("in_list")).alias("quote"))
    keep = (F.col("text") != "") | (F.col("bkind") == "item")
    look = F.transform(F.sequence(F.lit(0), F.col("k_d").cast("int")), lambda d: F.struct(d.alias("depth"), F.lit(1).alias("role"), none.alias("box")))
    roles = (F.when(F.col("bkind") == "box", F.array(F.struct(F.col("k_d").cast("int").alias("depth"), F.lit(0).alias("role"), here.alias("box"))))
             .otherwise(F.when(keep, look).otherwise(F.slice(look, 1, 1))))
    x = blocks.withColumn("keep", keep).withColumn("_r", F.explode(roles)).select("*", "_r.*").drop("_r")
    w = running(Window.partitionBy("page_id", "depth").orderBy("upos", "sub", "role"))
    x = x.withColumn("_in", F.last("box", ignorenulls=True).over(w)).filter("role = 1")
    others = ["keep"] + [c for c in blocks.columns if c not in ("page_id", "upos", "sub", "bkind")]
    g = x.groupBy("page_id", "upos", "sub", "bkind").agg(*[F.first(c).alias(c) for c in others], F.array_sort(F.collect_list(
        F.when(F.col("depth") > 0, F.struct("depth", F.col("_in").alias("box"))))).alias("path"))
    # Containers within a table cell or a pre have no row: they prefix nothing.
    own = F.when(F.col("bkind") == "item", F.col("k_d")).otherwise(F.lit(BIG))
    return g.withColumn("path", F.transform(F.filter("path", lambda p: p["box"].isNotNull() & (p["depth"] < own)), lambda p: p["box"]))


def path_prefix(path: Column, inside: Column) -> Column:
    """'> ' a quote, two blanks a list; three for the last one if that is the ordered list a block
    stands in (`inside`)."""
    return F.concat(F.array_join(F.transform(path, lambda p: F.when(p["quote"], F.lit("> ")).otherwise(F.lit("  "))), ""),
                    F.when(inside, F.lit(" ")).otherwise(F.lit("")))


def assemble_body(blocks: DataFrame) -> DataFrame:
    """(page_id, body, has_content): blocks joined in order.  Items of one list are
    separated by a newline, except after a nested list ends or between two lists
    (blank line); any other pair by a blank line, which the containers that hold both prefix."""
    blocks = container_paths(blocks)
    w = before(Window.partitionBy("page_id").orderBy("upos", "sub"))
    prev = F.last(F.when(F.col("keep"), F.struct("bkind", "l_d", "path", "list_id", "root_list")), ignorenulls=True).over(w)
    b = blocks.withColumn("_p", prev)
    p = lambda c: F.col(f"_p.{c}")
    same_list = (F.col("bkind") == "item") & (p("bkind") == "item") & (F.col("root_list") == p("root_list"))
    tight = same_list & ((F.col("l_d") > p("l_d")) | ((F.col("l_d") == p("l_d")) & (F.col("list_id") == p("list_id"))))
    # Paths are of containers that nest, so those that both hold are the leading ones.
    shared = F.array_intersect(F.col("path"), F.coalesce(p("path"), F.expr("slice(path, 1, 0)")))
    inside = F.coalesce(F.col("in_list") & F.col("ordered"), F.lit(False)) & (F.col("bkind") != "item")
    sep = (F.when(F.col("_p").isNull(), F.lit(""))
           .when(tight, F.lit("\n"))
           .otherwise(F.concat(F.lit("\n"), blank_prefix(path_prefix(shared, F.lit(False))), F.lit("\n"))))
    b = b.withColumn("piece", F.when(F.col("keep"), F.concat(sep, prefix_lines(F.col("text"), path_prefix(F.col("path"), inside)))))
    body = (b.groupBy("page_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                F.when(F.col("piece").isNotNull(), F.struct("upos", "sub", "piece")))), lambda x: x["piece"]), "").alias("body"),
                 F.max("has_content").alias("has_content")))
    return body.select("page_id", T.trim_ws(F.col("body")).alias("body"), "has_content")


def markdown_body(content: DataFrame, cfg: Config) -> DataFrame:
    return assemble_body(block_rows(content, cfg))
