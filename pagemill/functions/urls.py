"""URL helpers: Markdown URL of a canonical URL, `.md` route of a request path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme, user info, host, port, path, query, fragment.
URL_RX = (r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]{1,5}))?)?"
          r"([^?#]*)(?:\?([^#]*))?(?:#(.*))?$")


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, URL_RX, i)


def markdown_url(url: Column) -> Column:
    """Canonical URL -> Markdown URL: empty path or '/' -> '/index'; trailing slashes
    trimmed; '.md' appended unless present; port, query and fragment kept; user info
    dropped.  An unparsable URL is returned unchanged."""
    ok = url.rlike(URL_RX) & ((_part(url, 3) == "") | (_part(url, 3).try_cast("int") <= 65535))
    scheme, host, port, path, query, frag = (_part(url, i) for i in range(1, 7))
    has_auth = url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//")
    p = F.when((path == "") | (path == "/"), F.lit("/index")).otherwise(F.regexp_replace(path, r"[/\\]+$", ""))
    p = F.when(p.endswith(".md"), p).otherwise(F.concat(p, F.lit(".md")))
    out = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit("://"))).otherwise(F.lit("")),
        F.when(has_auth, host).otherwise(F.lit("")),
        F.when(port != "", F.concat(F.lit(":"), port.try_cast("int").cast("string"))).otherwise(F.lit("")),
        p,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")))
    return F.when(ok, out).otherwise(url)


def raw_url_decode(c: Column) -> Column:
    """%XX decoding that leaves '+' alone; malformed input is kept as is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def markdown_route(path: Column) -> Column:
    """Request path ending '.md' or '.md/' -> the route (decoded, slashes trimmed);
    NULL when the path is not a Markdown route or the route is blank."""
    rel = F.regexp_replace(F.regexp_extract(path, r"^([^?#]*)", 1), r"^/", "")
    cap = F.regexp_extract(rel, r"^(.+)\.md/?$", 1)
    route = F.regexp_replace(F.trim(raw_url_decode(cap)), r"^/+|/+$", "")
    return F.when((cap != "") & (route != ""), route)


def url_path(url: Column) -> Column:
    """Path of a URL ('' when none)."""
    return _part(url, 4)


def url_host(url: Column) -> Column:
    return T_lower(_part(url, 2))


def T_lower(c: Column) -> Column:
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, up, up.lower())
