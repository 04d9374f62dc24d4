"""Column -> Column string helpers.  All JVM-side expressions (codegen), no Python
per row."""

from __future__ import annotations

import html.entities
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Whitespace classes.  The `/u` patterns being reproduced are Unicode-aware, so `\s`
# becomes `(?U)\s` in Java; plain `trim()` strips " \t\n\r\0\x0B" only.
UWS = r"(?U)\s"
TRIM_CHARS = r"[ \t\n\r\x00\x0B]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def among(column: str, values: Sequence[str]) -> Column:
    """`column` IN fixed strings, as one expression (isin() makes a call to the JVM for each)."""
    return F.expr(column + " IN (" + ", ".join(f"'{v}'" for v in values) + ")")


def trim_ws(c) -> Column:
    """PHP-style trim(): only space, tab, LF, CR, NUL and VT."""
    return F.regexp_replace(_c(c), rf"^{TRIM_CHARS}+|{TRIM_CHARS}+$", "")


def trim_newlines(c) -> Column:
    return F.regexp_replace(_c(c), r"^\n+|\n+$", "")


def collapse_ws(c) -> Column:
    """Every Unicode whitespace run -> one space (line ends included), no trim."""
    return F.regexp_replace(_c(c), UWS + "+", " ")


def normalize_text(c) -> Column:
    """Text node normalisation: CR/LF to space and whitespace runs to one space."""
    return collapse_ws(c)


def normalize_inline(c) -> Column:
    """Flattened one-line text (links, cells, image text): collapse and trim."""
    return trim_ws(collapse_ws(c))


def normalize_code_block(c) -> Column:
    """`pre` text: CRLF / CR -> LF, outer newlines trimmed, nothing else touched."""
    return trim_newlines(F.regexp_replace(_c(c), r"\r\n?", "\n"))


def normalize_inline_code(c) -> Column:
    """Inline code: line ends -> space, space/tab runs -> one space, trimmed."""
    return trim_ws(F.regexp_replace(F.regexp_replace(_c(c), r"\r\n|\r|\n", " "), r"[ \t]+", " "))


def ascii_lower(c) -> Column:
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(_c(c), up, up.lower())


def longest_run(c, ch: str = "`") -> Column:
    """Length of the longest run of `ch`, 0 if none."""
    import re as _re
    pat = _re.escape(ch) + "+"
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(_c(c), F.lit(pat), 0),
                                              lambda x: F.length(x))), F.lit(0))


def fence(c, minimum: int) -> Column:
    return F.repeat(F.lit("`"), F.greatest(F.lit(minimum), longest_run(c) + 1))


def inline_code(c) -> Column:
    """`code` outside `pre`: fence one longer than the longest backtick run, padded with
    a space when the text starts or ends with a backtick; empty -> empty."""
    t = normalize_inline_code(c)
    pad = F.when(t.startswith("`") | t.endswith("`"), F.lit(" ")).otherwise(F.lit(""))
    f = fence(t, 1)
    return F.when(t == "", F.lit("")).otherwise(F.concat(f, pad, t, pad, f))


def fenced_code(c) -> Column:
    """`pre` block body (already normalised): fence max(3, run + 1), no language."""
    f = fence(c, 3)
    return F.when(_c(c) == "", F.lit("")).otherwise(F.concat(f, F.lit("\n"), _c(c), F.lit("\n"), f))


def yaml_key(c) -> Column:
    """Lower-case (ASCII), runs outside [a-z0-9_] -> '_', '_' trimmed."""
    k = F.regexp_replace(ascii_lower(c), r"[^a-z0-9_]+", "_")
    return F.regexp_replace(k, r"^_+|_+$", "")


def yaml_scalar(c) -> Column:
    """Escape backslash, then double quote; drop CR; LF -> \\n; wrap in quotes."""
    v = F.replace(_c(c), F.lit("\\"), F.lit("\\\\"))
    v = F.replace(v, F.lit('"'), F.lit('\\"'))
    v = F.replace(v, F.lit("\r"), F.lit(""))
    v = F.replace(v, F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), v, F.lit('"'))


def image_text_escape(c) -> Column:
    """Alt text: brackets escaped, whitespace collapsed, trimmed."""
    v = F.replace(F.replace(_c(c), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    return normalize_inline(v)


def image_title_escape(c) -> Column:
    v = F.replace(_c(c), F.lit('"'), F.lit('\\"'))
    return normalize_inline(v)


def table_cell_escape(c) -> Column:
    v = F.replace(_c(c), F.lit("|"), F.lit("\\|"))
    v = F.regexp_replace(v, r"\r\n|\r|\n", "<br>")
    return normalize_inline(v)


def strip_tags(c) -> Column:
    """Tag stripping used for excerpts: script/style with content, then any tag, then
    whitespace runs -> one space, trimmed.

    Linear whatever the text: a search for an end that isn't there runs to the end of the text and
    takes what it passed, so it is made once.  Of a script or style that never closes only the
    tag goes; the second and third pass look into what followed the first such tag.  A comment or a
    tag that never closes goes to the end."""
    v = _c(c)
    for names in ("script|style", "style", "script"):
        v = F.regexp_replace(v, rf"(?is)<({names})[^>]*+(?:>(?>.*?</\1>|(.*+))|\z)", "$2")
    v = F.regexp_replace(v, r"(?s)<!--(?>.*?-->|.*+)|<(?!\s)[^>]*+(?:>|\z)", "")
    v = F.regexp_replace(v, r"[\r\n\t ]+", " ")
    return trim_ws(v)


# ---------------------------------------------------------------------------
# Marks.  The conversion marks places in strings with the characters U+E000-E01F.  Texts that hold
# such characters themselves are rewritten without them, reversibly.

MARKS = "".join(map(chr, range(0xE000, 0xE020)))
_STAND_INS = "".join(map(chr, range(0xE020, 0xE040)))
_ESCAPE = "\ue040"


def shield(c) -> Column:
    """The text without any of MARKS: each is replaced by its stand-in (U+E020-E03F), and a
    stand-in or U+E040 that was there before gets U+E040 in front.  unshield() restores it."""
    v = _c(c)
    freed = F.translate(F.regexp_replace(v, "[\ue020-\ue040]", _ESCAPE + "$0"), MARKS, _STAND_INS)
    return F.when(v.rlike("[\ue000-\ue040]"), freed).otherwise(v)


def unshield(c) -> Column:
    """The text that was given to shield()."""
    v = _c(c)
    pieces = F.regexp_extract_all(v, F.lit("\ue040[\ue020-\ue040]|[^\ue040]++|\ue040"), 0)
    back = F.transform(pieces, lambda p: F.when(p.startswith(_ESCAPE), F.substring(p, 2, 1)).otherwise(F.translate(p, _STAND_INS, MARKS)))
    return F.when(v.rlike("[\ue020-\ue040]"), F.array_join(back, "")).otherwise(v)


# ---------------------------------------------------------------------------
# Entities.  The named-entity table is the HTML5 list shipped with Python's standard
# library (a parameter, not transcribed); only names that end in ';' are decoded.

_ENTITIES = json.dumps({k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")})


def entity_map() -> Column:
    """The HTML5 table as one constant map (about 2.1k entries), made from a single literal."""
    return F.from_json(F.lit(_ENTITIES), "map<string, string>")


def entity_table(spark: SparkSession) -> DataFrame:
    """(name, chars) for every HTML5 named entity; bounded size (~2.1k rows), so it
    is safe to broadcast."""
    return spark.range(1, numPartitions=1).select(F.explode(entity_map()).alias("ent_name", "ent_chars"))


def codepoint_char(cp: Column) -> Column:
    """Code point -> one-character string (UTF-32 decode; `chr` wraps at 256).
    Invalid code points (0, surrogates, > 0x10FFFF) become U+FFFD."""
    bad = (cp <= 0) | (cp > 0x10FFFF) | ((cp >= 0xD800) & (cp <= 0xDFFF))
    safe = F.when(bad, F.lit(0xFFFD)).otherwise(cp)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def numeric_entity(tok: Column) -> Column:
    """'&#65;' / '&#x41;' -> 'A'; NULL for anything else.  Leading zeros don't count; a
    number too long for a code point is invalid."""
    dec = F.regexp_extract(tok, r"^&#0*([0-9]+);$", 1)
    hx = F.regexp_extract(tok, r"^&#[xX]0*([0-9a-fA-F]+);$", 1)
    invalid = F.lit(0x110000).cast("long")
    cp = (F.when(F.length(dec) > 7, invalid).when(dec != "", dec.try_cast("long"))
          .when(F.length(hx) > 6, invalid).when(hx != "", F.conv(F.nullif(hx, F.lit("")), 16, 10).try_cast("long")))
    return F.when(cp.isNotNull(), codepoint_char(cp))


#: Text cut into character references and what stands between them.
REFERENCE_RX = r"&(?:#[0-9]++|#[xX][0-9a-fA-F]++|[A-Za-z][A-Za-z0-9]{0,31});|[^&]++|&"


#: Names looked up first: a map is searched from its start.
_FREQUENT = json.dumps({k: html.entities.html5[f"{k};"] for k in ("amp", "quot", "lt", "gt", "nbsp", "apos")})


def decode_references(c) -> Column:
    """Character references decoded once, within one value."""
    table, frequent = entity_map(), F.from_json(F.lit(_FREQUENT), "map<string, string>")

    def one(p: Column) -> Column:
        name = F.regexp_extract(p, r"^&([A-Za-z][A-Za-z0-9]*);$", 1)
        named = F.when(name != "", F.coalesce(F.try_element_at(frequent, name), F.try_element_at(table, name)))
        return F.when(p.startswith("&"), F.coalesce(named, numeric_entity(p), p)).otherwise(p)
    v = _c(c)
    return F.when(v.contains("&"), F.array_join(F.transform(F.regexp_extract_all(v, F.lit(REFERENCE_RX), 0), one), "")).otherwise(v)
