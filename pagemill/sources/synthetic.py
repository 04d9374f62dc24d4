"""HTML pages built from base-table rows inside a query (oracle kind B): the expected
Markdown follows from the rows themselves, without reading any HTML.  Every builder
is a Spark job over the driver's tables (ordered aggregation per page)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .pages import read_table


def esc(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _wrap(body: Column, root: str = "article") -> Column:
    return F.concat(F.lit(f"<!DOCTYPE html><html><head><title>t</title></head><body><{root}>"), body,
                    F.lit(f"</{root}></body></html>"))


def _ordered_concat(key: Column, piece: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), piece.alias("p")))),
                                    lambda x: x["p"]), "")


def _page(df: DataFrame, pid: Column, body: Column, root: str = "article") -> DataFrame:
    return df.select(pid.cast("long").alias("page_id"), F.concat(F.lit("http://fixture.test/p/"), pid.cast("string"))
                     .alias("url"), _wrap(body, root).alias("html"))


def _item_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k"), F.col("l_partkey").cast("string").alias("name"))


def table_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per order: a table of its items with a thead header row."""
    rows = _item_rows(spark, sf).groupBy("l_orderkey").agg(_ordered_concat(F.struct("k", "name"), F.concat(
        F.lit("<tr><td>"), F.col("k").cast("string"), F.lit("<td>"), F.col("name"), F.lit("</tr>"))).alias("r"))
    body = F.concat(F.lit("<table><thead><tr><th>key<th>name</tr></thead><tbody>"), F.col("r"),
                    F.lit("</tbody></table>"))
    return _page(rows, F.col("l_orderkey"), body)


def uneven_table_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without thead; the name cell is missing when key % 3 = 0 and holds a pipe
    when key % 5 = 0."""
    k = F.col("k")
    name = F.when(k % 5 == 0, F.concat(F.col("name"), F.lit(" | x"))).otherwise(F.col("name"))
    cell2 = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<td>"), esc(name), F.lit("</td>")))
    rows = _item_rows(spark, sf).groupBy("l_orderkey").agg(_ordered_concat(F.struct("k", "name"), F.concat(
        F.lit("<tr><td>"), k.cast("string"), F.lit("</td>"), cell2, F.lit("</tr>"))).alias("r"))
    return _page(rows, F.col("l_orderkey"), F.concat(F.lit("<table>"), F.col("r"), F.lit("</table>")))


def ordered_list_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per customer: an ordered list of all its orders by key."""
    o = read_table(spark, sf, "orders")
    rows = o.groupBy("o_custkey").agg(_ordered_concat(F.col("o_orderkey"), F.concat(
        F.lit("<li>"), F.col("o_orderkey").cast("string"), F.lit(" "), esc("o_orderpriority"), F.lit("</li>"))).alias("r"))
    return _page(rows, F.col("o_custkey"), F.concat(F.lit("<ol>"), F.col("r"), F.lit("</ol>")))


def _customer_orders(spark: SparkSession, sf: str, piece: Column) -> DataFrame:
    """c_custkey, c_name and r: `piece` of the customer's orders by key."""
    orders = read_table(spark, sf, "orders").groupBy("o_custkey").agg(_ordered_concat(F.col("o_orderkey"), piece).alias("r"))
    c = read_table(spark, sf, "customer")
    return orders.join(c, orders["o_custkey"] == c["c_custkey"]).select("c_custkey", "c_name", "r")


def nested_list_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per customer with orders: the customer as an item with the orders nested, text
    after the nested list, then a closing item."""
    j = _customer_orders(spark, sf, F.concat(F.lit("<li>"), esc("o_orderpriority"), F.lit("</li>")))
    body = F.concat(F.lit("<ul><li>"), esc("c_name"), F.lit("<ul>"), F.col("r"), F.lit("</ul>tail</li><li>after</li></ul>"))
    return _page(j, F.col("c_custkey"), body)


def list_in_quote_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per customer with orders: a quote of a paragraph and a list, then a paragraph."""
    j = _customer_orders(spark, sf, F.concat(F.lit("<li>"), esc("o_orderpriority")))
    return _page(j, F.col("c_custkey"), F.concat(F.lit("<blockquote><p>"), esc("c_name"), F.lit("</p><ul>"), F.col("r"), F.lit("</ul></blockquote><p>after")))


def quote_in_list_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per conversation: a list of its turns, each an item of the role with a quote of the
    text and, in that, a quote of the role."""
    c = read_table(spark, sf, "conversations")
    rows = c.groupBy("conv_id").agg(_ordered_concat(F.struct("turn", "role", "text"), F.concat(
        F.lit("<li>"), esc("role"), F.lit("<blockquote><p>x"), esc("text"), F.lit("</p><blockquote>"), esc("role"), F.lit("</blockquote></blockquote></li>"))).alias("r"))
    return _page(rows, F.col("conv_id"), F.concat(F.lit("<ul>"), F.col("r"), F.lit("</ul>")))


def code_in_item_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per event: an ordered list whose first item holds its JSON props as code between
    other lines, one of them blank."""
    e = read_table(spark, sf, "events")
    return _page(e, F.col("event_id"), F.concat(F.lit("<ol><li>"), F.col("event_id").cast("string"), F.lit("<pre>a\n\n"), esc("props"),
                                                F.lit("\n  b</pre></li><li>end</li></ol>")))


def table_in_item_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per order: a list item that holds the table of its items, then another item."""
    rows = _item_rows(spark, sf).groupBy("l_orderkey").agg(_ordered_concat(F.struct("k", "name"), F.concat(
        F.lit("<tr><td>"), F.col("k").cast("string"), F.lit("<td>"), F.col("name"))).alias("r"))
    return _page(rows, F.col("l_orderkey"), F.concat(F.lit("<ul><li>"), F.col("l_orderkey").cast("string"), F.lit("<table><tr><th>key<th>name"), F.col("r"),
                                                     F.lit("</table></li><li>end</ul>")))


def private_use_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per part: a private-use character (by p_partkey, U+E000-F8FF) beside names, in
    emphasis, a link, its target, an item, a cell and code, as itself and as a reference."""
    p = read_table(spark, sf, "part")
    code = F.lit(0xE000) + F.col("p_partkey") % 6400
    c, ref = T.codepoint_char(code), F.concat(F.lit("&#"), code.cast("string"), F.lit(";"))
    body = F.concat(F.lit("<p>"), c, F.lit("a<b>"), ref, esc("p_name"), F.lit('</b><a href="/'), c, F.lit('">'), ref, F.lit("</a></p><ul><li>"), ref, F.lit("</ul><pre>"),
                    c, F.lit("</pre><table><tr><td>"), c, F.lit("</table>"))
    return _page(p, F.col("p_partkey"), body)


def code_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per event: its JSON props in pre > code."""
    e = read_table(spark, sf, "events")
    return _page(e, F.col("event_id"), F.concat(F.lit("<pre><code>"), esc("props"), F.lit("</code></pre>")))


def backtick_text(partkey: Column, name: Column) -> Column:
    """p_partkey % 5 backticks at the start, end or middle (by p_partkey % 3)."""
    ticks = F.repeat(F.lit("`"), (partkey % 5).cast("int"))
    pos = partkey % 3
    return (F.when(pos == 0, F.concat(ticks, name)).when(pos == 1, F.concat(name, ticks))
            .otherwise(F.concat(F.lit("a "), ticks, F.lit(" "), name)))


def backtick_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part")
    t = esc(backtick_text(F.col("p_partkey"), F.col("p_name")))
    return _page(p, F.col("p_partkey"), F.concat(F.lit("<p><code>"), t, F.lit("</code></p><pre>"), t, F.lit("</pre>")))


def emphasis_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part")
    body = F.concat(F.lit("<p><em>"), esc("p_name"), F.lit("</em> <del>"), esc("p_brand"), F.lit("</del> <i> </i></p>"))
    return _page(p, F.col("p_partkey"), body)


def heading_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part")
    lvl = (F.col("p_partkey") % 6 + 1).cast("string")
    body = F.concat(F.lit("<h"), lvl, F.lit("> "), esc("p_name"), F.lit(" </h"), lvl, F.lit(">"))
    return _page(p, F.col("p_partkey"), body)


def break_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part")
    body = F.concat(F.lit("<p>"), esc("p_name"), F.lit("<br>"), esc("p_brand"), F.lit("<br></p><p><strong>"),
                    esc("p_type"), F.lit(" </strong></p>"))
    return _page(p, F.col("p_partkey"), body)


def transparent_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown / transparent tags and elements that render nothing."""
    p = read_table(spark, sf, "part")
    body = F.concat(F.lit("<div><span>"), esc("p_name"), F.lit("</span> <u>"), esc("p_brand"),
                    F.lit('</u><script>var x="</p>";</script><noscript>ns</noscript><template>tp</template>'
                          "<iframe>if</iframe> <font>"), esc("p_type"), F.lit("</font><!-- c --></div>"))
    return _page(p, F.col("p_partkey"), body)


def image_src_attr(partkey: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in ("src", "data-src", "data-lazy-src", "data-original", "")]),
                        (partkey % 5 + 1).cast("int"))


def image_pages(spark: SparkSession, sf: str) -> DataFrame:
    """figure > img + figcaption; source attribute by p_partkey % 5 (none when 4),
    empty alt every 4th, title every 3rd, a data: URL every 7th."""
    p = read_table(spark, sf, "part")
    k = F.col("p_partkey")
    url = F.when(k % 7 == 0, F.lit("data:image/png;base64,AAAA")).otherwise(
        F.concat(F.lit("/img/"), k.cast("string"), F.lit(".png")))
    attr = image_src_attr(k)
    src = F.when(attr == "", F.lit("")).otherwise(F.concat(F.lit(" "), attr, F.lit('="'), esc(url), F.lit('"')))
    alt = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("["), F.col("p_brand"), F.lit("] "), F.col("p_name")))
    title = F.when(k % 3 == 0, F.concat(F.lit(' title="say '), esc(F.concat(F.lit('"'), F.col("p_type"), F.lit('"'))),
                                        F.lit('"'))).otherwise(F.lit(""))
    body = F.concat(F.lit("<figure><img"), src, F.lit(' alt="'), esc(alt), F.lit('"'), title,
                    F.lit("><figcaption>"), esc("p_name"), F.lit("</figcaption></figure>"))
    return _page(p, k, body)


def quote_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per conversation: each turn as a quoted paragraph, then a rule."""
    c = read_table(spark, sf, "conversations")
    rows = c.groupBy("conv_id").agg(_ordered_concat(F.col("turn"), F.concat(
        F.lit("<blockquote><p>"), esc("text"), F.lit("</p></blockquote><hr>"))).alias("r"))
    return _page(rows, F.col("conv_id"), F.col("r"))


def selector_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per customer with orders: these as divs with id and classes inside a section
    under main; one decoy outside main."""
    k = F.col("o_orderkey")
    cls = F.concat(F.lit("nation k"), (k % 3).cast("string"), F.when(k % 4 == 0, F.lit(" hot")).otherwise(F.lit("")))
    rows = read_table(spark, sf, "orders").groupBy("o_custkey").agg(_ordered_concat(k, F.concat(
        F.lit('<div id="n'), k.cast("string"), F.lit('" class="'), cls, F.lit('"><p>'), esc("o_orderpriority"),
        F.lit("</p></div>"))).alias("r"))
    ck = F.col("o_custkey").cast("string")
    body = F.concat(F.lit('<main><section id="r'), ck, F.lit('" class="region r'), ck, F.lit('">'), F.col("r"),
                    F.lit('</section></main><div class="k1 hot">outside</div>'))
    return _page(rows, F.col("o_custkey"), body, root="div")


def response_pages(spark: SparkSession, sf: str) -> DataFrame:
    """pages + http_status and content_type by page_id (FIXTURES responses recipe)."""
    p = read_table(spark, sf, "pages")
    pid = F.col("page_id")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 204, 301, 404, 500)]), (pid % 5 + 1).cast("int"))
    ctype = F.element_at(F.array(*[F.lit(x) for x in ("text/html; charset=utf-8", "TEXT/HTML", "", "application/json")]),
                         (pid % 4 + 1).cast("int"))
    return p.select("page_id", "url", "html", status.alias("http_status"), ctype.alias("content_type"))


def strike_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Three struck tags, one of them empty, one nested in another."""
    p = read_table(spark, sf, "part")
    body = F.concat(F.lit("<p><s>"), esc("p_name"), F.lit("</s> x <strike>"), esc("p_brand"), F.lit("</strike><del> </del> <em><del>"),
                    esc("p_type"), F.lit("</del></em></p>"))
    return _page(p, F.col("p_partkey"), body)


def bullet_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per customer: a bullet list of its orders, closing tags left out every other time."""
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    rows = o.groupBy("o_custkey").agg(_ordered_concat(k, F.concat(F.lit("<li>"), k.cast("string"), F.lit(" <b>"), esc("o_orderstatus"), F.lit("</b>"),
                                                                  F.when(k % 2 == 0, F.lit("</li>")).otherwise(F.lit("")))).alias("r"))
    return _page(rows, F.col("o_custkey"), F.concat(F.lit("<ul>"), F.col("r"), F.lit("</ul>")))


def rule_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part")
    return _page(p, F.col("p_partkey"), F.concat(F.lit("<p>"), esc("p_name"), F.lit("<hr>"), esc("p_brand"), F.lit("<hr/><hr /><p>"), esc("p_type")))


def figure_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A figure in running text, its picture under one of two attributes."""
    p = read_table(spark, sf, "part")
    k = F.col("p_partkey")
    attr = F.when(k % 2 == 0, F.lit("src")).otherwise(F.lit("data-src"))
    return _page(p, k, F.concat(F.lit("before <figure> <img "), attr, F.lit("=/i?k="), k.cast("string"), F.lit(' alt="'), esc("p_brand"), F.lit('"> </figure> '), esc("p_name")))


def caption_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A caption with emphasis, between text; images are off."""
    p = read_table(spark, sf, "part")
    return _page(p, F.col("p_partkey"), F.concat(F.lit("<figure><img src=/a.png>"), esc("p_type"), F.lit("<figcaption>"), esc("p_name"), F.lit(" <i>"), esc("p_brand"),
                                                 F.lit("</i></figcaption></figure>tail")))


def cell_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with formatting, pipes, breaks and lists inside."""
    p = read_table(spark, sf, "part")
    return _page(p, F.col("p_partkey"), F.concat(F.lit("<table><tr><th>a|b<th> c </tr><tr><td><b>"), esc("p_name"), F.lit("</b>\n  x</td><td><ul><li>"), esc("p_brand"),
                                                 F.lit("</li></ul>|</td></tr></table>")))


def wrapper_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Tags that only wrap: unknown ones, and known ones without a meaning of their own."""
    p = read_table(spark, sf, "part")
    return _page(p, F.col("p_partkey"), F.concat(F.lit("<x-card><bdi>"), esc("p_name"), F.lit("</bdi><small> and </small><x-y z='1'>"), esc("p_brand"), F.lit("</x-y></x-card>")))


def card_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A link around a heading and a paragraph, its href without quotes and with '='."""
    p = read_table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    return _page(p, F.col("p_partkey"), F.concat(F.lit("<a\nclass='card\n big' href=/p?id="), k, F.lit("><h3>"), esc("p_name"), F.lit("</h3><p>"), esc("p_brand"), F.lit("</p></a>")))


def bold_block_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Bold around two paragraphs, then six levels of empty emphasis."""
    p = read_table(spark, sf, "part")
    return _page(p, F.col("p_partkey"), F.concat(F.lit("<b><p>"), esc("p_name"), F.lit("</p><p>"), esc("p_brand"), F.lit("</p></b><p>x"), F.lit("<b><i>" * 3 + "</i></b>" * 3), F.lit("y</p>")))


def open_nav_pages(spark: SparkSession, sf: str) -> DataFrame:
    """An excluded element left open within a closed section, and one that is inline."""
    p = read_table(spark, sf, "part")
    return _page(p, F.col("p_partkey"), F.concat(F.lit("<section><nav>"), esc("p_name"), F.lit("</section><span class='a\nad'><div>AD</div></span><p>"), esc("p_brand"), F.lit("</p>")), root="main")


def attribute_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Attribute values in every form, with references to be decoded once."""
    p = read_table(spark, sf, "part")
    k = F.col("p_partkey")
    v = F.element_at(F.array(F.lit("/q?a=1&amp;b=2"), F.lit('"/&eacute;&#61;&#38;amp;"'), F.lit("'/a\nb'"), F.lit('"/&#000065;&#x00042;"')), (k % 4 + 1).cast("int"))
    return _page(p, k, F.concat(F.lit("<?xml:namespace\nprefix = o ?><a id=\"x\"\nHREF = "), v, F.lit(" href=second>"), esc("p_name"), F.lit("</a>")))


def reference_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric references with zeros in front, and one beyond the last code point."""
    p = read_table(spark, sf, "part")
    k = F.col("p_partkey") % 26
    return _page(p, F.col("p_partkey"), F.concat(F.lit("<p>&#00000000"), (k + 65).cast("string"), F.lit(";&#X0000000"), F.lower(F.hex(k + 97)), F.lit(";&#99999999999;")))
