"""Independent DuckDB SQL for every registered query.

F oracles read the fixture HTML with regular-expression chains (a different method
from the token windows); B oracles never read HTML: they derive the expected
Markdown from the base rows the pages were built from.  Column names match
`catalog.py`."""

from __future__ import annotations

from ..config import Config
from ..sources.fixtures import ACCEPT_HEADERS, AS_OF, METHODS

WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TRIM = r"[ \t\n\r\x{00}\x{0B}]"
ENTITY_RE2 = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"regexp_replace({x}, {lit(WS + '+')}, ' ', 'g')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + TRIM + '+|' + TRIM + '+$')}, '', 'g')"


def inline(x: str) -> str:
    return trim(norm(x))


def dec(x: str) -> str:
    """The character references present in the fixtures; '&amp;' last."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                 ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def yaml_scalar(x: str) -> str:
    v = f"replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(13), ''), chr(10), '\\n')"
    return f"('\"' || {v} || '\"')"


def url_part(x: str, i: int) -> str:
    """scheme (1), host (2), port (3), path (4), query (5), fragment (6), by cutting the string
    at the delimiters, not by a pattern."""
    page = f"split_part({x}, '#', 1)"
    if i == 6:
        return f"(CASE WHEN strpos({x}, '#') > 0 THEN substr({x}, strpos({x}, '#') + 1) ELSE '' END)"
    if i == 5:
        return f"(CASE WHEN strpos({page}, '?') > 0 THEN substr({page}, strpos({page}, '?') + 1) ELSE '' END)"
    base = f"split_part({page}, '?', 1)"
    rest = f"(CASE WHEN strpos({base}, '://') > 0 THEN substr({base}, strpos({base}, '://') + 3) ELSE {base} END)"
    authority = f"split_part({rest}, '/', 1)"
    host = f"substr({authority}, strpos({authority}, '@') + 1)"
    return {1: f"(CASE WHEN strpos({base}, '://') > 0 THEN split_part({base}, '://', 1) ELSE '' END)",
            2: f"split_part({host}, ':', 1)", 3: f"split_part({host}, ':', 2)", 4: f"substr({rest}, length({authority}) + 1)"}[i]


def md_url(u: str) -> str:
    path = url_part(u, 4)
    p = f"(CASE WHEN {path} IN ('', '/') THEN '/index' ELSE regexp_replace({path}, '[/\\\\]+$', '') END)"
    p = f"(CASE WHEN ends_with({p}, '.md') THEN {p} ELSE {p} || '.md' END)"
    auth = f"regexp_matches({u}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//')"
    return (f"(CASE WHEN {url_part(u, 1)} <> '' THEN {url_part(u, 1)} || '://' ELSE '' END"
            f" || CASE WHEN {auth} THEN {url_part(u, 2)} ELSE '' END"
            f" || CASE WHEN {url_part(u, 3)} <> '' THEN ':' || CAST(CAST({url_part(u, 3)} AS INTEGER) AS VARCHAR) ELSE '' END"
            f" || {p}"
            f" || CASE WHEN {url_part(u, 5)} <> '' THEN '?' || {url_part(u, 5)} ELSE '' END"
            f" || CASE WHEN {url_part(u, 6)} <> '' THEN '#' || {url_part(u, 6)} ELSE '' END)")


def fence(run: str, minimum: int) -> str:
    return f"repeat('`', greatest({minimum}, {run} + 1))"


def longest(x: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({x}, '`+'), lambda r: length(r))), 0)"


# ------------------------------------------------------------------ shared CTEs

META = f"""meta AS (
  SELECT p.page_id, p.url, p.html, p.page_id % 4 AS site_id,
    CASE WHEN p.page_id % 29 <> 0 THEN ['post','page','product'][p.page_id % 3 + 1] END AS type,
    regexp_extract({url_part('p.url', 4)}, '([^/]+)/*$', 1) AS slug,
    regexp_extract(p.html, '(?is)<title>(.*?)</title>', 1) AS title,
    CASE WHEN p.page_id % 7 = 0 THEN 'Short <em>excerpt</em> &amp; more for page ' || p.page_id ELSE '' END AS excerpt,
    d.text AS content,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(p.page_id AS BIGINT)) AS published_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(p.page_id + p.page_id % 48 AS BIGINT)) AS modified_at,
    CASE WHEN p.page_id % 11 = 0 THEN 'draft' ELSE 'publish' END AS status,
    p.page_id % 13 = 0 AS password_protected
  FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id)"""

SERVABLE = """servable AS (
  SELECT m.page_id, CASE WHEN coalesce(m.type, '') NOT IN ('post', 'page') THEN 'type_disabled'
    WHEN m.password_protected THEN 'password_protected'
    WHEN m.status <> 'publish' THEN 'not_public'
    WHEN l.doc_id IS NOT NULL THEN 'noindex' END AS deny_reason
  FROM meta m LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = m.page_id)"""


def _strip(x: str) -> str:
    v = f"regexp_replace({x}, '(?is)<(script|style)[^>]*?>.*?</(script|style)>', '', 'g')"
    v = f"regexp_replace({v}, '(?s)<!--.*?-->|<[^>]*>', '', 'g')"
    return trim(f"regexp_replace({v}, '[\\r\\n\\t ]+', ' ', 'g')")


def _excerpt(e: str, c: str) -> str:
    se, sc = _strip(f"coalesce({e}, '')"), _strip(f"coalesce({c}, '')")
    src = f"(CASE WHEN {se} <> '' THEN {se} ELSE {sc} END)"
    v = norm(dec(src))
    words = f"list_filter(string_split({v}, ' '), lambda w: w <> '')"
    return (f"(CASE WHEN {trim(v)} = '' THEN NULL WHEN len({words}) > 40 "
            f"THEN array_to_string({words}[1:40], ' ') || '...' ELSE {v} END)")


def _iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


FM = f"""fm AS (
  SELECT page_id, site_id, url,
    'title: ' || {yaml_scalar(dec('title'))} || chr(10) ||
    'id: ' || {yaml_scalar('CAST(page_id AS VARCHAR)')} || chr(10) ||
    'type: ' || {yaml_scalar(chr(99) + "oalesce(type, '')")} || chr(10) ||
    'slug: ' || {yaml_scalar('slug')} || chr(10) ||
    'published_at: ' || {yaml_scalar(_iso('published_at'))} || chr(10) ||
    'modified_at: ' || {yaml_scalar(_iso('modified_at'))} || chr(10) ||
    'url: ' || {yaml_scalar('url')} || chr(10) ||
    'markdown_url: ' || {yaml_scalar(md_url('url'))} || chr(10) ||
    coalesce('excerpt: ' || {yaml_scalar(_excerpt('excerpt', 'content'))} || chr(10), '') ||
    CASE WHEN lang <> '' THEN 'taxonomy_content_lang:' || chr(10) || '  - ' || {yaml_scalar('lang')} || chr(10) ELSE '' END ||
    CASE WHEN host <> '' THEN 'taxonomy_host:' || chr(10) || '  - ' || {yaml_scalar('host')} || chr(10) ELSE '' END AS yaml
  FROM (SELECT *, regexp_extract(html, '<html[^>]*\\blang="([^"]*)"', 1) AS lang, lower({url_part('url', 2)}) AS host FROM meta))"""


def _bold(part: str) -> str:
    inner = inline(dec(f"regexp_extract({part}, '^<b>(.*?)<br>', 1)"))
    return f"(CASE WHEN {inner} = '' THEN '' ELSE '**' || {inner} || '**' END)"


ART = f"""art AS (
  SELECT page_id, {inline(dec("regexp_extract(a, '<h1>(.*?)</h1>', 1)"))} AS h1,
    list_filter(list_transform(string_split(regexp_replace(a, '^.*?</h1>', ''), '<p>')[2:],
      lambda x: CASE WHEN starts_with(x, '<b>') THEN {_bold('x')} ELSE {inline(dec("regexp_replace(x, '</p>$', '')"))} END),
      lambda t: t <> '') AS paras
  FROM (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS a FROM pages))"""

BODY = """body AS (SELECT page_id, '# ' || h1 || CASE WHEN len(paras) > 0 THEN chr(10) || chr(10) || array_to_string(paras, chr(10) || chr(10)) ELSE '' END AS body FROM art)"""

DOCS = f"""docs AS (SELECT b.page_id, f.site_id, '---' || chr(10) || f.yaml || '---' || chr(10) || chr(10) || {trim('b.body')} || chr(10) AS document
  FROM body b JOIN fm f USING (page_id))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


REQ = f"""req AS (
  SELECT e.event_id AS req_id, e.event_type, e.event_id, {url_part('p.url', 4)} AS upath, lower({url_part('p.url', 2)}) AS host,
    {'CASE ' + ' '.join(f"WHEN e.event_type = {lit(k)} THEN {lit(v)}" for k, v in METHODS.items()) + " ELSE 'GET' END"} AS method,
    {('[' + ', '.join(lit(a) for a in ACCEPT_HEADERS) + ']')}[e.event_id % {len(ACCEPT_HEADERS)} + 1] AS accept
  FROM events e LEFT JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)),
req2 AS (
  SELECT *, CASE WHEN event_id % 19 = 0 THEN '/' WHEN event_id % 2 = 0 THEN
      (CASE WHEN event_id % 17 = 0 THEN '/no-such-page-' || event_id
            ELSE (CASE WHEN regexp_replace(upath, '/+$', '') = '' THEN '/index' ELSE regexp_replace(upath, '/+$', '') END) END) || '.md'
    ELSE (CASE WHEN event_id % 17 = 0 THEN '/no-such-page-' || event_id WHEN upath = '' THEN '/' ELSE upath END) END AS path
  FROM req)"""


def _route(path: str) -> str:
    rel = f"regexp_replace(regexp_extract({path}, '^([^?#]*)', 1), '^/', '')"
    cap = f"regexp_extract({rel}, '^(.+)\\.md/?$', 1)"
    r = f"regexp_replace(trim(url_decode(replace({cap}, '+', '%2B'))), '^/+|/+$', '', 'g')"
    return f"(CASE WHEN {cap} <> '' AND {r} <> '' THEN {r} END)"


def _key(path: str) -> str:
    return f"regexp_replace(trim(url_decode(replace({path}, '+', '%2B'))), '^/+|/+$', '', 'g')"


RESOLVED = f"""paths AS (SELECT page_id, lower({url_part('url', 2)}) AS host, {_key(url_part('url', 4))} AS k FROM pages),
resolved AS (
  SELECT r.*, {_route('r.path')} IS NOT NULL AS is_md,
    CASE WHEN lower({_route('r.path')}) = 'index'
      THEN coalesce((SELECT min(page_id) FROM paths p WHERE p.host = r.host AND lower(p.k) = 'index'), (SELECT min(page_id) FROM paths p WHERE p.host = r.host AND p.k = ''))
      ELSE (SELECT min(page_id) FROM paths p WHERE p.host = r.host AND p.k = coalesce({_route('r.path')}, {_key('r.path')})) END AS page_id
  FROM req2 r)"""


def _ranges(a: str) -> str:
    qrx = "(?i)^q\\s*=\\s*(.+)$"
    parse = (f"lambda v: struct_pack(parts := list_transform(string_split(v, ';'), lambda p: {trim('p')}))")
    ranges = (f"list_transform(list_transform(string_split(coalesce({a}, ''), ','), {parse}), lambda s: struct_pack("
              f"media := lower(s.parts[1]), "
              f"qvals := list_transform(list_filter(s.parts[2:], lambda p: regexp_matches(p, {lit(qrx)})), "
              f"lambda p: {trim('regexp_extract(p, ' + lit(qrx) + ', 1)')})))")
    mrx = "^([a-z0-9!#$&^_.+*\\-]+)/([a-z0-9!#$&^_.+*\\-]+)$"
    qv = "^(?:0(?:\\.\\d{0,3})?|1(?:\\.0{0,3})?)$"
    return (f"list_transform(list_filter({ranges}, lambda s: regexp_matches(s.media, {lit(mrx)}) AND "
            f"len(list_filter(s.qvals, lambda q: NOT regexp_matches(q, {lit(qv)}))) = 0), lambda s: struct_pack("
            f"type := regexp_extract(s.media, {lit(mrx)}, 1), subtype := regexp_extract(s.media, {lit(mrx)}, 2), "
            f"quality := coalesce(TRY_CAST(s.qvals[-1] AS DOUBLE), 1.0)))")


def _mq(ranges: str, t: str, st: str) -> str:
    spec = (f"CASE WHEN r.type = '{t}' AND r.subtype = '{st}' THEN 2 WHEN r.type = '{t}' AND r.subtype = '*' THEN 1 "
            f"WHEN r.type = '*' AND r.subtype = '*' THEN 0 ELSE -1 END")
    scored = f"list_filter(list_transform({ranges}, lambda r: struct_pack(s := {spec}, q := r.quality)), lambda x: x.s >= 0)"
    return f"coalesce(list_max({scored}), struct_pack(s := -1, q := -1.0))"


def _prefers(a: str, need: int) -> str:
    md, html = _mq(_ranges(a), "text", "markdown"), _mq(_ranges(a), "text", "html")
    return f"coalesce(({md}).s >= {need} AND ({md}).q > 0 AND ({md}).q >= greatest(0.0, ({html}).q), false)"


def _store(cfg: Config, absent: bool = False) -> str:
    """Document store fixture; one in six under other options; with `absent`, even pages only."""
    other = cfg.replace(include_images=True)
    return f"""store AS (
  SELECT m.page_id, m.site_id,
    md5(concat_ws('|', CAST(m.site_id AS VARCHAR), '{cfg.generation}', CAST(m.page_id AS VARCHAR),
        strftime(m.modified_at, '%Y-%m-%d %H:%M:%S'), '{cfg.locale}',
        CASE WHEN m.page_id % 6 = 0 THEN '{other.options_hash}' ELSE '{cfg.options_hash}' END, md5(m.html))) AS fingerprint,
    TIMESTAMP '{AS_OF}' - to_hours(CAST(m.page_id % 24 AS BIGINT)) - INTERVAL 30 MINUTE AS converted_at
  FROM meta m{' WHERE m.page_id % 2 = 0' if absent else ''})"""


def _fp(cfg: Config) -> str:
    return f"""fp AS (SELECT page_id, md5(concat_ws('|', CAST(site_id AS VARCHAR), '{cfg.generation}', CAST(page_id AS VARCHAR),
    strftime(modified_at, '%Y-%m-%d %H:%M:%S'), '{cfg.locale}', '{cfg.options_hash}', md5(html))) AS fingerprint FROM meta)"""


LIVE = f"""live AS (SELECT * FROM store WHERE epoch(TIMESTAMP '{AS_OF}') - epoch(converted_at) < 43200
  AND epoch(TIMESTAMP '{AS_OF}') - epoch(converted_at) >= 0)"""


#: Pages with comments, then raw elements, cut out and counted; what is left is counted by kind.
CUT = """cut AS (SELECT page_id, html, len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS n_comment,
    len(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:script|style)[ >].*?</(?:script|style)>')) AS n_raw,
    regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', chr(1), 'g'), '(?is)<(?:script|style)[ >].*?</(?:script|style)>', chr(1), 'g') AS rest FROM pages)"""


# Element depth of each tag in the fixture page layout.
FIXTURE_DEPTH = {"html": 1, "head": 2, "body": 2, "meta": 3, "title": 3, "style": 3, "script": 3, "nav": 3,
                 "div": 3, "article": 3, "footer": 3, "ul": 4, "li": 5, "a": 6, "h1": 4, "p": 4, "b": 5, "br": 6}


def oracles() -> dict[str, str]:
    cfg = Config()
    md = {}
    md["load_pages"] = "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars FROM pages"
    md["admit_pages"] = f"""SELECT page_id, CASE WHEN st < 200 OR st >= 300 THEN 'http_status'
      WHEN ct <> '' AND strpos(lower(ct), 'text/html') = 0 THEN 'content_type'
      WHEN regexp_replace(html, {lit(TRIM)}, '', 'g') = '' THEN 'empty_html' END AS reject_reason
    FROM (SELECT page_id, html, [200, 204, 301, 404, 500][page_id % 5 + 1] AS st,
      ['text/html; charset=utf-8', 'TEXT/HTML', '', 'application/json'][page_id % 4 + 1] AS ct FROM pages)"""
    md["write_documents"] = _with(META, FM, ART, BODY, DOCS) + \
        "SELECT site_id, count(*) AS n_docs, CAST(sum(length(document)) AS BIGINT) AS n_chars FROM docs GROUP BY site_id"
    md["stream_pages"] = _with(META, FM, ART, BODY, DOCS) + "SELECT page_id, md5(document) AS doc_md5 FROM docs"
    bare = "regexp_replace(rest, '<[^>]*>', chr(1), 'g')"
    cut_refs = f"regexp_replace({bare}, {lit(ENTITY_RE2)}, chr(1), 'g')"
    md["page_tokens"] = _with(CUT) + f"""SELECT page_id,
      n_comment + n_raw + len(regexp_extract_all(rest, '<[^>]*>')) + n_entity + len(list_filter(string_split({cut_refs}, chr(1)), lambda t: t <> '')) AS n_tokens,
      CAST(length(html) AS BIGINT) AS n_chars, len(regexp_extract_all(rest, '<[A-Za-z]')) AS n_open, len(regexp_extract_all(rest, '</[A-Za-z]')) AS n_close,
      n_comment, n_raw, n_entity
    FROM (SELECT *, len(regexp_extract_all({bare}, {lit(ENTITY_RE2)})) AS n_entity FROM cut)"""
    depth = "CASE tag " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FIXTURE_DEPTH.items()) + " END"
    md["page_nodes"] = _with(CUT) + f"""SELECT page_id, tag, CAST(sum(o) AS BIGINT) AS n_nodes,
      CAST(CASE WHEN tag IN ('meta', 'br', 'script', 'style') THEN 0 ELSE least(sum(o), sum(c)) END AS BIGINT) AS n_closed, CAST({depth} AS BIGINT) AS max_depth
    FROM (SELECT page_id, lower(unnest(regexp_extract_all(rest, '<([A-Za-z][^ >/]*)', 1))) AS tag, 1 AS o, 0 AS c FROM cut
      UNION ALL SELECT page_id, lower(unnest(regexp_extract_all(rest, '</([A-Za-z][^ >/]*)', 1))) AS tag, 0 AS o, 1 AS c FROM cut
      UNION ALL SELECT page_id, lower(unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)[ >].*?</(?:script|style)>', 1))) AS tag, 1 AS o, 0 AS c FROM cut)
    GROUP BY page_id, tag HAVING sum(o) > 0"""
    attr_dec = lambda x: dec(x)
    md["tag_attributes"] = f"""SELECT page_id, CAST(len(regexp_extract_all(html, '<a[\\s>]')) AS BIGINT) AS n_links,
      array_to_string(list_transform(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), lambda h: {attr_dec('h')}), ' ') AS hrefs
    FROM pages WHERE len(regexp_extract_all(html, '<a[\\s>]')) > 0
    UNION ALL SELECT 10000000000 + p_partkey, 1, ['/q?a=1&b=2', '/é=&amp;', '/a' || chr(10) || 'b', '/AB'][p_partkey % 4 + 1] FROM part"""
    md["normalize_text"] = f"SELECT doc_id, {norm('text')} AS norm, {inline('text')} AS inline FROM documents"
    md["drop_padding"] = ("SELECT page_id, CAST(len(regexp_extract_all(html, '>[ \\t\\n\\r\\x{0B}]+<')) AS BIGINT) "
                          "AS n_padding FROM pages")
    ent = "lambda e: CASE e WHEN '&amp;' THEN '&' WHEN '&quot;' THEN '\"' WHEN '&copy;' THEN '©' WHEN '&middot;' THEN '·' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' ELSE e END"
    md["decode_entities"] = f"""SELECT page_id, CAST(len(es) AS BIGINT) AS n_entities, array_to_string(list_transform(es, {ent}), '') AS decoded
    FROM (SELECT page_id, regexp_extract_all(html, {lit(ENTITY_RE2)}) AS es FROM pages) WHERE len(es) > 0
    UNION ALL SELECT 10000000000 + p_partkey, 3, chr(CAST(p_partkey % 26 + 65 AS INTEGER)) || chr(CAST(p_partkey % 26 + 97 AS INTEGER)) || chr(65533) FROM part"""
    stripped = _strip("html")
    md["plain_text"] = f"SELECT page_id, {trim(chr(10).join([]) or dec(stripped))} AS text FROM pages"
    ok = "lpad(CAST(o_orderkey AS VARCHAR), 12, '0')"
    md["match_selector"] = "SELECT o_custkey AS page_id, " + ", ".join(
        f"coalesce(string_agg(CASE WHEN {c} THEN {ok} END, ',' ORDER BY {ok}), '') AS {n}" for n, c in (
            ("child", "o_orderkey % 3 = 1"), ('"desc"', "o_orderkey % 4 = 0"), ("compound", "o_orderkey % 3 = 2"), ("id", "o_orderkey = 3"))) + " FROM orders GROUP BY o_custkey"
    md["match_any"] = ("SELECT page_id, CAST(len(regexp_extract_all(html, '<h1[\\s>]')) + len(regexp_extract_all(html, "
                       "'class=\"ad\"')) + len(regexp_extract_all(html, '<nav[\\s>]')) + len(regexp_extract_all(html, '<li[\\s>]')) "
                       "AS BIGINT) AS n_matches FROM pages")
    md["main_content"] = """SELECT page_id, 'div' AS root_tag, 'ad' AS root_class, CAST(1 AS BIGINT) AS root_rank
      FROM pages WHERE strpos(html, '<div class="ad">') > 0"""

    def vis(x: str) -> str:
        v = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
        v = f"regexp_replace({v}, '<[^>]*>', ' ', 'g')"
        return inline(dec(v))
    body_in = "regexp_extract(html, '(?s)<body>(.*?)(?:</body>|$)', 1)"
    cut = f"regexp_replace(regexp_replace(regexp_replace({body_in}, '(?s)<nav>.*?</nav>', ' ', 'g'), '(?s)<footer>.*?</footer>', ' ', 'g'), '(?s)<div class=\"ad\">.*?</div>', ' ', 'g')"
    md["drop_excluded"] = f"SELECT page_id, {vis(cut)} AS text FROM pages UNION ALL SELECT 10000000000 + p_partkey, {inline('p_brand')} FROM part"
    md["content_subtree"] = f"SELECT page_id, {vis(chr(40) + 'regexp_extract(html, ' + lit('(?s)<article>(.*)</article>') + ', 1))')} AS text FROM pages"
    md["md_headings"] = f"SELECT p_partkey AS page_id, repeat('#', CAST(p_partkey % 6 + 1 AS INTEGER)) || ' ' || {inline('p_name')} AS body FROM part"
    md["md_paragraphs"] = _with(ART) + """SELECT page_id, CAST(len(paras) AS BIGINT) AS n_para, array_to_string(paras, chr(10) || chr(10)) AS paras
      FROM art WHERE len(paras) > 0"""
    md["md_breaks"] = f"""SELECT p_partkey AS page_id, {inline('p_name')} || '  ' || chr(10) || {inline('p_brand')} || chr(10) || chr(10) || '**' || {inline('p_type')} || '**' AS body FROM part"""
    md["md_strong"] = _with(ART) + """SELECT page_id, CAST(len(list_filter(paras, lambda t: starts_with(t, '**'))) AS BIGINT) AS n_strong,
      array_to_string(list_filter(paras, lambda t: starts_with(t, '**')), chr(10)) AS strong FROM art
      WHERE len(list_filter(paras, lambda t: starts_with(t, '**'))) > 0
      UNION ALL SELECT 10000000000 + p_partkey, 3, '**' || """ + inline("p_name") + """ || '**' || chr(10) || '**' || """ + inline("p_brand") + """ || '**' || chr(10) || 'xy' FROM part"""
    md["md_emphasis"] = f"SELECT p_partkey AS page_id, '*' || {inline('p_name')} || '* ~~' || {inline('p_brand')} || '~~' AS body FROM part"
    md["md_strikethrough"] = f"SELECT p_partkey AS page_id, '~~' || {inline('p_name')} || '~~ x ~~' || {inline('p_brand')} || '~~ *~~' || {inline('p_type')} || '~~*' AS body FROM part"
    bt = ("(CASE p_partkey % 3 WHEN 0 THEN repeat('`', CAST(p_partkey % 5 AS INTEGER)) || p_name WHEN 1 THEN p_name || "
          "repeat('`', CAST(p_partkey % 5 AS INTEGER)) ELSE 'a ' || repeat('`', CAST(p_partkey % 5 AS INTEGER)) || ' ' || p_name END)")
    ti = trim(f"regexp_replace({bt}, '[ \\t]+', ' ', 'g')")
    pad = f"(CASE WHEN starts_with({ti}, '`') OR ends_with({ti}, '`') THEN ' ' ELSE '' END)"
    md["md_inline_code"] = (f"SELECT p_partkey AS page_id, {fence(longest(ti), 1)} || {pad} || {ti} || {pad} || {fence(longest(ti), 1)}"
                            f" || chr(10) || chr(10) || {fence(longest(bt), 3)} || chr(10) || {bt} || chr(10) || {fence(longest(bt), 3)} AS body FROM part")
    md["md_fenced_code"] = (f"SELECT event_id AS page_id, {fence(longest('props'), 3)} || chr(10) || props || chr(10) || "
                            f"{fence(longest('props'), 3)} AS body FROM events")
    md["longest_run"] = f"SELECT p_partkey, CAST({longest(bt)} AS BIGINT) AS longest FROM part"
    nav = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"
    item = ("'- ' || CASE WHEN trim(h) = '' THEN ts[i] WHEN ts[i] = '' THEN '[' || trim(h) || '](' || trim(h) || ')' "
            "ELSE '[' || ts[i] || '](' || trim(h) || ')' END")
    md["md_links"] = f"""SELECT page_id, array_to_string(list_transform(hs, lambda h, i: {item}), chr(10)) AS body
      FROM (SELECT page_id, list_transform(regexp_extract_all({nav}, '<a href="([^"]*)">', 1), lambda h: {dec('h')}) AS hs,
        list_transform(regexp_extract_all({nav}, '<a href="[^"]*">(.*?)</a>', 1), lambda t: {inline(dec('t'))}) AS ts FROM pages)
      UNION ALL SELECT 10000000000 + p_partkey, '[' || {inline('p_name || p_brand')} || '](/p?id=' || p_partkey || ')' FROM part"""
    md["md_unordered_lists"] = "SELECT o_custkey AS page_id, string_agg('- ' || o_orderkey || ' **' || o_orderstatus || '**', chr(10) ORDER BY o_orderkey) AS body FROM orders GROUP BY o_custkey"
    md["md_ordered_lists"] = f"""SELECT o_custkey AS page_id, string_agg(rn || '. ' || o_orderkey || ' ' || {inline('o_orderpriority')}, chr(10) ORDER BY o_orderkey) AS body
      FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) GROUP BY o_custkey"""
    of_customer = f"""SELECT c_custkey, c_name, string_agg('@- ' || {inline('o_orderpriority')}, chr(10) ORDER BY o_orderkey) AS items
      FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"""
    md["md_nested_lists"] = f"""SELECT c_custkey AS page_id, '- ' || {inline('c_name || ' + lit('tail'))} || chr(10) || replace(items, '@', '  ') || chr(10) || chr(10) || '- after' AS body
      FROM ({of_customer})"""
    md["md_list_in_quote"] = f"""SELECT c_custkey AS page_id, '> ' || {inline('c_name')} || chr(10) || '> ' || chr(10) || replace(items, '@', '> ') || chr(10) || chr(10) || 'after' AS body
      FROM ({of_customer})"""
    md["md_quote_in_list"] = f"""SELECT conv_id AS page_id, string_agg('- ' || role || chr(10) || chr(10) || '  > ' || {inline(chr(40) + lit('x') + " || coalesce(text, '')" + chr(41))} || chr(10) || '  > ' || chr(10) || '  > > ' || role,
      chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id"""
    md["md_code_in_item"] = (f"SELECT event_id AS page_id, '1. ' || event_id || chr(10) || chr(10) || '   ' || {fence(longest('props'), 3)} || chr(10) || '   a' || chr(10) || chr(10) || '   ' || props || chr(10) || "
                             f"'     b' || chr(10) || '   ' || {fence(longest('props'), 3)} || chr(10) || chr(10) || '2. end' AS body FROM events")
    md["md_table_in_item"] = """SELECT l_orderkey AS page_id, '- ' || l_orderkey || chr(10) || chr(10) || '  | key | name |' || chr(10) || '  | --- | --- |' || chr(10) ||
        string_agg('  | ' || l_linenumber || ' | ' || l_partkey || ' |', chr(10) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) || chr(10) || chr(10) || '- end' AS body
      FROM lineitem GROUP BY l_orderkey"""
    pu, two = "chr(CAST(57344 + p_partkey % 6400 AS INTEGER))", "chr(10) || chr(10)"
    md["md_private_use"] = f"""SELECT p_partkey AS page_id, {pu} || 'a**' || {pu} || {inline('p_name')} || '**[' || {pu} || '](/' || {pu} || ')' || {two} || '- ' || {pu} || {two}
        || '```' || chr(10) || {pu} || chr(10) || '```' || {two} || '| ' || {pu} || ' |' || chr(10) || '| --- |' AS body FROM part"""
    md["md_blockquotes"] = f"""SELECT conv_id AS page_id, string_agg(CASE WHEN {inline('text')} = '' THEN '---' ELSE '> ' || {inline('text')} || chr(10) || chr(10) || '---' END,
      chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id"""
    nl = " || chr(10) || chr(10) || "
    md["md_rules"] = f"SELECT p_partkey AS page_id, {inline('p_name')}{nl}'---'{nl}{inline('p_brand')}{nl}'---'{nl}'---'{nl}{inline('p_type')} AS body FROM part"
    src_attr = "['src', 'data-src', 'data-lazy-src', 'data-original', ''][p_partkey % 5 + 1]"
    url = "(CASE WHEN p_partkey % 7 = 0 THEN 'data:image/png;base64,AAAA' ELSE '/img/' || p_partkey || '.png' END)"
    alt = "(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '[' || p_brand || '] ' || p_name END)"
    alt_md = f"(CASE WHEN {inline(alt)} = '' THEN 'Image' ELSE {inline(alt)} END)"
    alt_esc = inline(f"replace(replace({alt_md}, '[', '\\['), ']', '\\]')")
    title = "(CASE WHEN p_partkey % 3 = 0 THEN 'say \"' || p_type || '\"' ELSE '' END)"
    title_esc = inline(f"replace({inline(title)}, '\"', '\\\"')")
    img = (f"'![' || {alt_esc} || '](' || {url} || CASE WHEN {title_esc} <> '' THEN ' \"' || {title_esc} || '\"' ELSE '' END || ')'")
    has = f"({src_attr} <> '' AND p_partkey % 7 <> 0)"
    md["md_images"] = f"SELECT p_partkey AS page_id, CASE WHEN {has} THEN {img} || chr(10) || chr(10) ELSE '' END || {inline('p_name')} AS body FROM part"
    md["md_figures"] = f"SELECT p_partkey AS page_id, 'before'{nl}'![' || {inline('p_brand')} || '](/i?k=' || p_partkey || ')'{nl}{inline('p_name')} AS body FROM part"
    md["md_captions"] = f"SELECT p_partkey AS page_id, {inline('p_type')}{nl}{inline('p_name')} || ' *' || {inline('p_brand')} || '*'{nl}'tail' AS body FROM part"
    md["image_source"] = f"SELECT p_partkey AS page_id, CASE WHEN {src_attr} = '' THEN '' ELSE {url} END AS src FROM part"
    md["image_escape"] = (f"SELECT p_partkey AS page_id, {inline(chr(40) + 'replace(replace(' + alt + ', ' + lit('[') + ', ' + lit('\\[') + '), ' + lit(']') + ', ' + lit('\\]') + ')' + chr(41))} AS alt, "
                          f"{title_esc} AS title FROM part")
    md["image_url_clean"] = f"SELECT p_partkey AS page_id, {has} AS kept FROM part"
    cell2 = f"replace({inline(chr(40) + 'CASE WHEN k % 5 = 0 THEN name || ' + lit(' | x') + ' ELSE name END' + chr(41))}, '|', '\\|')"
    rows = "(SELECT l_orderkey, l_linenumber AS k, CAST(l_partkey AS VARCHAR) AS name FROM lineitem)"
    md["md_tables"] = f"""SELECT l_orderkey AS page_id, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) ||
        string_agg('| ' || k || ' | ' || {inline('name')} || ' |', chr(10) ORDER BY k, name) AS body FROM {rows} GROUP BY 1
      UNION ALL
      SELECT l_orderkey + 10000000000 AS page_id, string_agg(CASE WHEN rn = 1 THEN line || chr(10) || '|' || repeat(' --- |', CAST(ncol AS INTEGER)) ELSE line END,
          chr(10) ORDER BY k, name) AS body
      FROM (SELECT *, '| ' || k || CASE WHEN k % 3 = 0 THEN (CASE WHEN ncol = 2 THEN ' |  |' ELSE ' |' END)
                ELSE ' | ' || {cell2} || ' |' END AS line
            FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k, name) AS rn,
                   max(CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END) OVER (PARTITION BY l_orderkey) AS ncol FROM {rows}))
      GROUP BY l_orderkey"""
    md["md_table_cells"] = f"SELECT p_partkey AS page_id, '| a\\|b | c |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || {inline('p_name')} || ' x | ' || {inline('p_brand')} || '\\| |' AS body FROM part"
    md["drop_elements"] = f"SELECT p_partkey AS page_id, {inline(chr(40) + 'p_name || ' + lit(' ') + ' || p_brand || ' + lit(' ') + ' || p_type' + chr(41))} AS body FROM part"
    md["transparent_elements"] = f"SELECT p_partkey AS page_id, {inline('p_name')} || ' and ' || {inline('p_brand')} AS body FROM part"
    cl = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"
    cl = f"regexp_replace({cl}, '(?m)^[^\\S\\n]+(#{{1,6}}[^\\S\\n]+)', '\\1', 'g')"
    cl = f"regexp_replace({cl}, '(?m)^[^\\S\\n]([-*+][^\\S\\n]|\\d+\\.[^\\S\\n])', '\\1', 'g')"
    cl = f"regexp_replace({cl}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    md["cleanup_lines"] = f"SELECT conv_id, turn, {trim(cl)} AS cleaned FROM conversations"
    md["markdown_body"] = _with(ART, BODY) + "SELECT page_id, body FROM body"
    md["front_matter"] = _with(META, FM) + "SELECT page_id, yaml FROM fm"
    md["excerpt"] = _with(META) + f"SELECT page_id, {_excerpt('excerpt', 'content')} AS excerpt FROM meta"
    lang = "regexp_extract(html, '<html[^>]*\\blang=\"([^\"]*)\"', 1)"
    md["taxonomy_terms"] = f"""SELECT page_id, 'taxonomy_content_lang' AS key, {lang} AS vals FROM pages WHERE {lang} <> ''
      UNION ALL SELECT page_id, 'taxonomy_host' AS key, lower({url_part('url', 2)}) AS vals FROM pages WHERE {url_part('url', 2)} <> ''"""
    yk = "regexp_replace(regexp_replace(lower(lang || ' -- ' || source || '_' || doc_id || '!'), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')"
    md["yaml_key"] = f"SELECT doc_id, {yk} AS key FROM documents"
    md["yaml_scalar"] = f"SELECT conv_id, turn, {yaml_scalar('text')} AS scalar FROM conversations"
    md["yaml_block"] = f"""SELECT conv_id, 'conversation_id: ' || {yaml_scalar('CAST(conv_id AS VARCHAR)')} || chr(10) ||
      'role: ' || {yaml_scalar('min(role)')} || chr(10) || 'turns:' || chr(10) ||
      string_agg('  - ' || {yaml_scalar('text')}, chr(10) ORDER BY turn) || chr(10) AS yaml FROM conversations GROUP BY conv_id"""
    md["markdown_url"] = f"SELECT page_id, {md_url('url')} AS markdown_url FROM pages"
    href = f"replace(replace(replace({md_url('m.url')}, '&', '&#038;'), '\"', '&quot;'), '''', '&#039;')"
    md["alternate_link"] = _with(META, SERVABLE) + f"""SELECT m.page_id, '<link rel="alternate" type="text/markdown" title="Markdown version" href="' || {href} || '" />' AS link
      FROM meta m JOIN servable s USING (page_id) WHERE s.deny_reason IS NULL"""
    md["convert_pages"] = _with(META, FM, ART, BODY, DOCS) + """SELECT page_id, CASE WHEN fail_reason IS NULL THEN document END AS document, fail_reason FROM (
      SELECT page_id, document, CASE WHEN page_id % 5 > 1 THEN 'http_status' WHEN page_id % 4 = 3 THEN 'content_type'
        WHEN page_id % 31 = 8 THEN 'no_metadata' WHEN page_id % 8 = 5 THEN 'no_content' END AS fail_reason FROM docs)"""
    md["assemble_document"] = f"""SELECT conv_id, turn, '---' || chr(10) || 'role: ' || {yaml_scalar('role')} || chr(10) || '---' || chr(10) || chr(10) ||
      {trim('text')} || chr(10) AS document FROM conversations"""
    md["enabled_types"] = _with(META) + "SELECT page_id, type FROM meta WHERE type IN ('post', 'page')"
    md["not_protected"] = _with(META) + "SELECT page_id FROM meta WHERE NOT password_protected AND status = 'publish'"
    md["not_noindex"] = _with(META) + "SELECT page_id FROM meta WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
    md["servable_pages"] = _with(META, SERVABLE) + "SELECT page_id, deny_reason FROM servable"
    md["markdown_route"] = _with(REQ) + f"SELECT req_id, path, {_route('path')} AS route FROM req2"
    md["resolve_requests"] = md["resolve_indexed"] = _with(REQ, RESOLVED) + "SELECT req_id, is_md, page_id FROM resolved"
    rg = _ranges("accept")
    md["accept_ranges"] = _with(REQ) + f"""SELECT req_id, CAST(len({rg}) AS BIGINT) AS n_ranges,
      array_to_string(list_transform({rg}, lambda r: r.type || '/' || r.subtype || ';' || CAST(CAST(round(r.quality * 1000) AS BIGINT) AS VARCHAR)), ',') AS ranges FROM req2"""
    mq_md, mq_html = _mq(rg, "text", "markdown"), _mq(rg, "text", "html")
    md["media_quality"] = _with(REQ) + f"""SELECT req_id, CAST(({mq_md}).s AS BIGINT) AS md_spec, CAST(round(({mq_md}).q * 1000) AS BIGINT) AS md_q,
      CAST(({mq_html}).s AS BIGINT) AS html_spec, CAST(round(({mq_html}).q * 1000) AS BIGINT) AS html_q FROM req2"""
    md["prefers_markdown"] = _with(REQ) + f"SELECT req_id, {_prefers('accept', 2)} AS conservative, {_prefers('accept', 1)} AS wildcards FROM req2"
    cls = _with(META, SERVABLE, REQ, RESOLVED, _store(cfg), LIVE) + f"""SELECT req_id, page_id, representation, CAST(status AS INTEGER) AS status, reason FROM (
      SELECT r.req_id, r.page_id,
        r.page_id IS NOT NULL AND s.deny_reason IS NULL AS ok, r.page_id IN (SELECT page_id FROM live) AS has_doc, r.is_md,
        NOT r.is_md AND upper(r.method) IN ('GET', 'HEAD') AND r.page_id IS NOT NULL AND s.deny_reason IS NULL AS neg,
        {_prefers('r.accept', 2)} AS wants, s.deny_reason
      FROM resolved r LEFT JOIN servable s ON s.page_id = r.page_id) x,
    LATERAL (SELECT
      CASE WHEN is_md AND ok AND has_doc THEN 'markdown' WHEN is_md THEN 'error' WHEN neg AND wants AND has_doc THEN 'markdown'
           WHEN neg AND wants THEN 'error' ELSE 'html' END AS representation,
      CASE WHEN is_md AND page_id IS NULL THEN 404 WHEN is_md AND NOT ok THEN 404 WHEN is_md AND NOT has_doc THEN 503
           WHEN is_md THEN 200 WHEN neg AND wants AND NOT has_doc THEN 503 WHEN neg AND wants THEN 200 END AS status,
      CASE WHEN is_md AND page_id IS NULL THEN 'unresolved' WHEN is_md AND NOT ok THEN deny_reason
           WHEN (is_md OR (neg AND wants)) AND NOT has_doc THEN 'no_document' END AS reason) y"""
    md["classify_requests"] = md["classify_stream"] = cls
    md["varies_on_accept"] = _with(META, SERVABLE, REQ, RESOLVED) + """SELECT r.req_id,
      coalesce(NOT r.is_md AND upper(r.method) IN ('GET', 'HEAD') AND r.page_id IS NOT NULL AND s.deny_reason IS NULL, false) AS varies_on_accept
      FROM resolved r LEFT JOIN servable s ON s.page_id = r.page_id"""
    md["fingerprint"] = _with(META, _fp(cfg)) + "SELECT page_id, fingerprint FROM fp"
    md["stale_pages"] = _with(META, _store(cfg, True), LIVE, _fp(cfg)) + \
        "SELECT page_id FROM fp WHERE (page_id, fingerprint) NOT IN (SELECT (page_id, fingerprint) FROM live)"
    md["expire_documents"] = _with(META, _store(cfg), LIVE) + "SELECT page_id FROM store WHERE page_id NOT IN (SELECT page_id FROM live)"
    md["bump_generation"] = _with(META, _store(cfg, True), LIVE, _fp(cfg.bump_generation())) + \
        "SELECT page_id FROM fp WHERE (page_id, fingerprint) NOT IN (SELECT (page_id, fingerprint) FROM live)"
    md["refresh_documents"] = _with(META, FM, ART, BODY, DOCS, _store(cfg, True), LIVE, _fp(cfg)) + f"""SELECT page_id, {cfg.generation} AS generation,
        from_store, CASE WHEN from_store THEN '---' || chr(10) || 'url: ' || url || chr(10) || '---' || chr(10) || chr(10) || 'stored' || chr(10) ELSE document END AS document
      FROM (SELECT fp.page_id, url, document, (fp.page_id, fingerprint) IN (SELECT (page_id, fingerprint) FROM live) AS from_store
        FROM fp JOIN meta USING (page_id) JOIN docs USING (page_id))"""
    md["refresh_store"] = md["refresh_documents"]
    md["purge_site"] = md["purge_store"] = _with(META, _store(cfg)) + "SELECT page_id, site_id FROM store WHERE site_id <> 2"
    md["retired_documents"] = _with(META, SERVABLE, _store(cfg)) + \
        "SELECT st.page_id FROM store st LEFT JOIN servable s USING (page_id) WHERE s.deny_reason IS NOT NULL OR s.page_id IS NULL"
    return md
