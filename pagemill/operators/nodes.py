"""Element structure from token rows, without a recursive walk or a stack.

Every quantity is a window over tokens of one page (partitioned by page_id, so no
exchange beyond the one before tokenizing):

* nesting depth of a family of tags = running sum of +1/-1 with stray closes
  dropped (running minimum trick);
* an element's end (`hi`, inclusive) = its paired close (per-tag depth), or for
  elements that close implicitly, the position before the next terminator;
* global depth = running sum over open/close events; parent = last element opened
  one level up (a window partitioned by (page_id, depth)).

Broken-markup contract: void tags never open; `p` ends at the next block boundary, and so
does an inline tag without a close of its own in its parent; `li` ends at the next item or
the end of its list, `dt`/`dd` at the next of them or the end of theirs; `td`/`th`/`tr` at the
next cell/row or the end of their table; stray closes are dropped; any other unclosed element
ends where its parent ends, and so does one whose close comes after its parent's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Tags that start or end a block (terminate `p` and open inline tags).
BLOCK_TAGS = ["address", "article", "aside", "blockquote", "body", "caption", "dd", "details",
              "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
              "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main",
              "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
              "thead", "tr", "ul", "iframe", "noscript", "template"]
# Inline tags that end at the next block boundary when left open.
INLINE_TAGS = ["a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font",
               "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike",
               "strong", "sub", "sup", "tt", "u", "var", "time"]
LIST_TAGS = ["ul", "ol"]
TABLE_SECTION_TAGS = ["thead", "tbody", "tfoot"]
CELL_TAGS = ["td", "th"]
DEFINITION_TAGS = ["dt", "dd"]

BIG = 2 ** 31 - 1


def page_order() -> Window:
    return Window.partitionBy("page_id").orderBy("pos")


def running(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def is_open(tags=None) -> Column:
    c = (F.col("kind") == "open") & ~F.col("is_void")
    return c if tags is None else c & T.among("tag", tags)


def is_close(tags=None) -> Column:
    c = F.col("kind") == "close"
    return c if tags is None else c & T.among("tag", tags)


def whole(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def nest_depths(df: DataFrame, fams: dict, partition: list[str] | None = None, beside: dict[str, Column] | None = None) -> DataFrame:
    """Depth of nesting for families of tags, per token, in document order.

    `fams` maps a column name to (opens, closes).  Opens count themselves; a close
    reports the depth of what it closes; stray closes (nothing open) are ignored and
    flagged in `{name}_stray`.  Two window passes over one sort, whatever the number
    of families.  `beside`: other window columns over the same partitions and order, which the
    first pass takes along."""
    keys = ["page_id"] + (partition or [])
    w = Window.partitionBy(*keys).orderBy("pos")
    df = df.withColumns({**{f"_{n}_r": F.sum(F.when(o, 1).when(c, -1).otherwise(0)).over(running(w))
                            for n, (o, c) in fams.items()}, **(beside or {})})
    # The least so far is that before the row or the row's own: one frame gives both.
    df = df.withColumns({f"_{n}_pm": F.least(F.lit(0), F.min(f"_{n}_r").over(before(w))) for n in fams})
    out = {}
    for n, (o, c) in fams.items():
        r, pm = F.col(f"_{n}_r"), F.col(f"_{n}_pm")
        stray = c & (r < pm)
        eff = r - F.least(pm, r)
        out[f"{n}_stray"] = stray
        out[n] = F.when(c & ~stray, eff + 1).otherwise(eff)
    df = df.withColumns(out)
    return df.drop(*[f"_{n}_{x}" for n in fams for x in ("r", "pm")])


def nest_depth(df: DataFrame, name: str, opens: Column, closes: Column,
               partition: list[str] | None = None) -> DataFrame:
    return nest_depths(df, {name: (opens, closes)}, partition)


def next_pos(df: DataFrame, events: dict, partition: list[str] | None = None) -> DataFrame:
    """For each name -> event condition: position of the next event row after each
    row (NULL if none).  A descending running frame scans each partition once."""
    keys = ["page_id"] + (partition or [])
    w = Window.partitionBy(*keys).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({n: F.min(F.when(e, F.col("pos"))).over(w) for n, e in events.items()})


def element_spans(tokens: DataFrame) -> DataFrame:
    """Adds to every token: `list_d`, `tbl_d` (list / table nesting) and, on element
    open rows, `hi` (last position inside the element, inclusive) and `closed`."""
    # Family depths needed by the implicit-close rules; with them, the page's end and the terminators of
    # `p` and open inline tags: any block-tag open or close.
    lists = LIST_TAGS + ["dl"]
    block_ev = T.among("kind", ["open", "close"]) & T.among("tag", BLOCK_TAGS)
    df = tokens.withColumn("_bev", F.when(block_ev, F.col("pos")))
    df = nest_depths(df, {"list_d": (is_open(lists), is_close(lists)),
                          "tbl_d": (is_open(["table"]), is_close(["table"]))}, beside={
        "_last": F.max("pos").over(whole(page_order())),
        "_nblk": F.expr("lead(_bev, 1) IGNORE NULLS OVER (PARTITION BY page_id ORDER BY pos)")})
    # Per-tag pairing of explicit closes: depth within the tag, then the next event
    # at the same tag and depth is the close when it is one.
    tagged = T.among("kind", ["open", "close"]) & ~F.col("is_void")
    df = nest_depth(df.withColumn("_tg", F.when(tagged, F.col("tag"))), "_td",
                    is_open() & F.col("_tg").isNotNull(), is_close() & F.col("_tg").isNotNull(), ["_tg"])
    wp = Window.partitionBy("page_id", "_tg", "_td").orderBy("pos")
    df = df.withColumn("_pair", F.when(is_open() & (F.lead("kind").over(wp) == "close"), F.lead("pos").over(wp)))
    # Where the innermost enclosing container that has a close ends: the next close at its
    # depth, counting only containers with a close (so opens and closes balance).
    wpair = Window.partitionBy("page_id", "_tg", "_td").orderBy("pos")
    paired_close = is_close() & (F.lag("kind").over(wpair) == "open")
    inline = T.among("tag", ["p"] + INLINE_TAGS)
    df = df.withColumns({"_po": F.col("_pair").isNotNull() & ~inline, "_pc": paired_close & ~inline})
    df = nest_depth(df, "_pd", F.col("_po"), F.col("_pc"))
    df = next_pos(df, {"_pend": F.col("_pc")}, ["_pd"])
    # `li`: next item or list end at the same list depth.
    li_ev = (T.among("kind", ["open", "close"]) & (F.col("tag") == "li")) | is_close(LIST_TAGS)
    dt_ev = (T.among("kind", ["open", "close"]) & T.among("tag", DEFINITION_TAGS)) | is_close(["dl"])
    # Cells and rows: next cell / row / section event or table end at the same depth.
    row_ev = (T.among("kind", ["open", "close"]) & T.among("tag", ["tr"] + TABLE_SECTION_TAGS)) \
        | is_close(["table"])
    cell_ev = row_ev | (T.among("kind", ["open", "close"]) & T.among("tag", CELL_TAGS))
    # Tags of lists and of tables are different ones, so one sort serves both; other rows have no part in it.
    in_list, in_table = T.among("tag", ["li"] + DEFINITION_TAGS + lists), T.among("tag", ["table", "tr"] + CELL_TAGS + TABLE_SECTION_TAGS)
    df = df.withColumn("_fam", F.when(in_list, F.lit(1)).when(in_table, F.lit(2)))
    df = df.withColumn("_famd", F.when(F.col("_fam") == 1, F.col("list_d")).when(F.col("_fam") == 2, F.col("tbl_d")))
    df = next_pos(df, {"_nli": li_ev, "_ndt": dt_ev, "_ncell": cell_ev, "_nrow": row_ev}, ["_fam", "_famd"])
    tag = F.col("tag")
    term = (F.when(T.among("tag", ["p"] + INLINE_TAGS), F.col("_nblk"))
            .when(tag == "li", F.col("_nli"))
            .when(T.among("tag", DEFINITION_TAGS), F.col("_ndt"))
            .when(T.among("tag", CELL_TAGS), F.col("_ncell"))
            .when(tag == "tr", F.col("_nrow")))
    pair = F.col("_pair")
    parent_end = F.coalesce(F.col("_pend") - 1, F.lit(BIG))
    # An inline element with a close inside its parent ends there, whatever blocks it
    # holds; any other element ends at its close unless a terminator or the end of its parent
    # comes first.  (At a container that has a close, _pend is where as many containers have
    # closed as opened since: its own close, unless an outer one's came before that.)
    term = F.when(T.among("tag", INLINE_TAGS) & (pair <= parent_end), F.lit(None)).otherwise(term)
    within = F.when(F.col("_po"), F.coalesce(F.col("_pend"), F.lit(BIG))).otherwise(parent_end)
    hi = (F.when(F.col("kind") == "raw", F.col("pos"))
          .when(F.col("is_void"), F.col("pos"))
          .when(F.col("kind") == "open",
                F.when(pair.isNotNull() & (pair <= F.coalesce(term, F.lit(BIG))) & (pair <= within), pair)
                .otherwise(F.least(F.coalesce(term - 1, F.lit(BIG)), parent_end, F.col("_last")))))
    df = df.withColumn("hi", hi)
    df = df.withColumn("closed", F.when(F.col("kind") == "open", pair.isNotNull() & (pair == F.col("hi"))))
    return df.drop("_tg", "_td", "_td_stray", "_pair", "_nblk", "_bev", "_nli", "_ndt", "_ncell", "_nrow", "_last",
                   "_fam", "_famd", "_po", "_pc", "_pd", "_pd_stray", "_pend",
                   "list_d_stray", "tbl_d_stray")


def with_tree(spans: DataFrame) -> DataFrame:
    """Adds `depth` (elements containing the token, itself included for element rows),
    `parent` (open position of the innermost strictly enclosing element) and `parent_tag`
    to every token row.  Two explode-and-window passes; partitioning is kept."""
    elem = (T.among("kind", ["open", "raw"]))
    # Pass 1: +1 at an element's open, -1 just after its last position.
    ev = F.when(elem & ~F.col("is_void") & (F.col("kind") == "open"), F.array(
        F.struct(F.col("pos").alias("epos"), F.lit(1).alias("eord"), F.lit(1).alias("d"), F.lit(True).alias("own")),
        F.struct((F.col("hi") + 1).alias("epos"), F.lit(0).alias("eord"), F.lit(-1).alias("d"), F.lit(False).alias("own"))
    )).otherwise(F.array(F.struct(F.col("pos").alias("epos"), F.lit(1).alias("eord"),
                                  F.lit(0).alias("d"), F.lit(True).alias("own"))))
    x = spans.withColumn("_e", F.explode(ev)).select("*", "_e.*").drop("_e")
    w = Window.partitionBy("page_id").orderBy("epos", "eord")
    x = x.withColumn("_run", F.sum("d").over(running(w))).filter("own").drop("epos", "eord", "d", "own")
    # Containment count of the token itself: voids and raw elements add themselves.
    x = x.withColumn("depth", F.col("_run") + F.when(elem & (F.col("is_void") | (F.col("kind") == "raw")), 1)
                     .otherwise(0)).drop("_run")
    # Pass 2: parent = last element opened at depth (own containment level).
    # Element rows take part twice: as a candidate at their own depth, and as a
    # child looking one level up.
    own_level = F.when(elem, F.col("depth") - 1).otherwise(F.col("depth"))
    none = F.lit(None).cast("struct<pos: int, tag: string>")
    roles = F.when(elem, F.array(
        F.struct(F.col("depth").alias("key"), F.lit(0).alias("role"), F.struct("pos", "tag").alias("cand")),
        F.struct(own_level.alias("key"), F.lit(1).alias("role"), none.alias("cand"))
    )).otherwise(F.array(F.struct(own_level.alias("key"), F.lit(1).alias("role"), none.alias("cand"))))
    y = x.withColumn("_r", F.explode(roles)).select("*", "_r.*").drop("_r")
    w2 = Window.partitionBy("page_id", "key").orderBy("pos", "role")
    y = y.withColumn("_p", F.last("cand", ignorenulls=True).over(running(w2)))
    return y.withColumns({"parent": F.col("_p.pos"), "parent_tag": F.col("_p.tag")}).filter(F.col("role") == 1).drop("key", "role", "cand", "_p")


# Parents in which white space next to an element is only indentation.
PADDING_PARENTS = ["body", "div", "section", "article", "main", "header", "footer", "aside",
                   "ul", "ol", "li", "table", "thead", "tbody", "tr", "td", "th"]


def is_padding() -> Column:
    """Over rows of with_tree() with `prev_kind`, `prev_void`, `next_kind`: a text node of
    white space alone, in one of PADDING_PARENTS, with an element as a neighbour."""
    blank = (F.col("kind") == "text") & (F.regexp_replace("text", r"[ \t\n\r\x00\x0B]", "") == "")
    text = ["text", "entity"]
    alone = ~F.coalesce(F.col("prev_kind").isin(text), F.lit(False)) & ~F.coalesce(F.col("next_kind").isin(text), F.lit(False))
    after = F.col("prev_kind").isin("close", "raw") | ((F.col("prev_kind") == "open") & F.col("prev_void"))
    return blank & alone & F.coalesce(F.col("parent_tag").isin(PADDING_PARENTS), F.lit(False)) & \
        (F.coalesce(after, F.lit(False)) | F.coalesce(F.col("next_kind").isin("open", "raw"), F.lit(False)))


def drop_padding(tree: DataFrame) -> DataFrame:
    """Tokens (rows of with_tree()) without the white space that only indents elements."""
    w = page_order()
    t = tree.withColumns({"prev_kind": F.lag("kind").over(w), "prev_void": F.lag("is_void").over(w), "next_kind": F.lead("kind").over(w)})
    return t.filter(~is_padding()).drop("prev_kind", "prev_void", "next_kind")


def class_list(attrs: Column) -> Column:
    """Whitespace separated classes (XML whitespace), empty entries removed."""
    raw = F.coalesce(attrs.getItem("class"), F.lit(""))
    return F.filter(F.split(F.trim(F.regexp_replace(raw, r"[ \t\r\n]+", " ")), " "), lambda c: c != "")


def page_nodes(tokens: DataFrame) -> DataFrame:
    """Element rows: (page_id, node_id, parent_id, tag, id, classes, attrs, depth,
    lo, hi, closed).  `node_id` and `lo` are the open tag's position; `hi` is the last
    position inside the element (its close tag when it has one)."""
    t = with_tree(element_spans(tokens))
    return (t.filter(T.among("kind", ["open", "raw"]))
            .select("page_id", F.col("pos").alias("node_id"), F.col("parent").alias("parent_id"), "tag",
                    F.col("attrs").getItem("id").alias("id"), class_list(F.col("attrs")).alias("classes"),
                    "attrs", "depth", F.col("pos").alias("lo"), "hi", F.coalesce("closed", F.lit(False)).alias("closed")))
