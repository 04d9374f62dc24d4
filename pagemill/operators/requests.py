"""Request decisions: which representation and status each request would get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, ConfigError
from ..functions.accept import accept_ranges, markdown_preferred
from ..functions.urls import T_lower, markdown_route, raw_url_decode, url_host, url_path


#: Tasks over which the requests of one route are spread.
SALTS = 16
#: The route that '/index.md' asks for.
INDEX = "\x00index"


def _key(path_col: Column) -> Column:
    return F.regexp_replace(F.trim(raw_url_decode(path_col)), r"^/+|/+$", "")


def page_routes(pages: DataFrame) -> DataFrame:
    """(route_host, route, routed_id): the page of each host's URL path (without surrounding
    slashes, decoded).  '' is the host's root, INDEX the page named index, else the root.
    Where several pages of a host share a path (queries), the lowest page_id wins."""
    return _first_routes(_route_candidates(pages))


def _route_candidates(pages: DataFrame) -> DataFrame:
    """(route_host, route, rank, page_id): every page under each of its routes."""
    p = pages.select("page_id", url_host(F.col("url")).alias("route_host"), _key(url_path(F.col("url"))).alias("route"))
    own = p.select("route_host", "route", F.lit(0).alias("rank"), "page_id")
    index = p.filter(F.lower("route").isin("index", "")).select("route_host", F.lit(INDEX).alias("route"), F.when(F.col("route") == "", 1).otherwise(0).alias("rank"), "page_id")
    return own.unionByName(index)


def _first_routes(candidates: DataFrame) -> DataFrame:
    return (candidates.groupBy("route_host", "route").agg(F.min(F.struct("rank", "page_id")).alias("first"))
            .select("route_host", "route", F.col("first.page_id").alias("routed_id")))


def _front_page(cfg: Config, site: Column | None) -> Column | None:
    front = cfg.site_front_page_id
    if front is None:
        return None
    if isinstance(front, int):
        return F.lit(front).cast("long")
    if site is None:
        raise ConfigError("front pages by site need requests with site_id")
    out = F.lit(None).cast("long")
    for s, page in front:
        out = F.when(site == s, F.lit(page).cast("long")).otherwise(out)
    return out


def _routed(requests: DataFrame) -> DataFrame:
    route = markdown_route(F.col("path"))
    own = F.when(route.isNotNull(), F.when(F.lower(route) == "index", F.lit(INDEX)).otherwise(route)).otherwise(_key(F.col("path")))
    return requests.withColumns({"is_md": route.isNotNull(), "route_key": own})


def _resolve(keys: DataFrame, pages: DataFrame, cfg: Config) -> DataFrame:
    """Distinct keys + page_id (NULL when unresolved)."""
    return _resolve_routes(keys, page_routes(pages), cfg)


def _resolve_routes(keys: DataFrame, routes: DataFrame, cfg: Config) -> DataFrame:
    if "host" in keys.columns:
        out = keys.join(routes, (T_lower(F.col("host")) == F.col("route_host")) & (F.col("route_key") == F.col("route")), "left")
    else:  # one site: the host doesn't matter
        any_host = routes.groupBy("route").agg(F.min("routed_id").alias("routed_id"))
        out = keys.join(any_host, F.col("route_key") == F.col("route"), "left")
    front = _front_page(cfg, F.col("site_id") if "site_id" in keys.columns else None)
    page = F.col("routed_id")
    if front is not None:
        page = F.when(F.col("route_key").isin("", INDEX), F.coalesce(front, page)).otherwise(page)
    return out.withColumn("page_id", page).drop("route_host", "route", "routed_id")


def _attach(requests: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with the columns decided for their (distinct) keys.  The requests of a hot
    key are spread over SALTS tasks, where the few rows of the other side are repeated."""
    left = requests.withColumn("_salt", F.pmod(F.xxhash64("req_id"), F.lit(SALTS)).cast("int"))
    right = decided.withColumnsRenamed({k: f"_r_{k}" for k in keys}).withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = F.col("_salt") == F.col("_r_salt")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, on, "left").drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])


def _route_keys(requests: DataFrame) -> list[str]:
    return [*[c for c in ("host", "site_id") if c in requests.columns], "is_md", "route_key"]


def save_routes(pages: DataFrame, table: str, path: str, buckets: int = 32) -> None:
    """Keep the routes of `pages` as a table bucketed and sorted by (host, route), its files in
    `path`, a shared folder: a bucket a file."""
    rows = _route_candidates(pages).repartition(buckets, "route_host", "route")
    (rows.write.bucketBy(buckets, "route_host", "route").sortBy("route_host", "route")
     .option("path", path).mode("overwrite").saveAsTable(table))


def saved_routes(spark: SparkSession, table: str) -> DataFrame:
    """page_routes() of a saved table: its rows stay in their buckets, for the choice of the first page
    of a route as for joins by (host, route)."""
    return _first_routes(spark.table(table))


def resolve_requests(requests: DataFrame, pages: DataFrame, cfg: Config, routes: DataFrame | None = None) -> DataFrame:
    """requests + is_md, route_key, page_id (NULL when unresolved).  routes: saved_routes() in place
    of those of `pages`; then requests alone are moved, to the buckets of their routes.

    requests: req_id, path, and host where there are several sites (site_id for front pages by
    site).  '.md' routes use the captured route, other requests their own path; '/' and
    '/index.md' are the front page.  Each distinct route is resolved once: requests are
    aggregated to their routes before the join with the pages, then take the answer back."""
    r = _routed(requests)
    keys = _route_keys(requests)
    found = _resolve_routes(r.select(*keys).distinct(), page_routes(pages) if routes is None else routes, cfg)
    return _attach(r, found, keys)


def classify_requests(requests: DataFrame, pages: DataFrame, servable: DataFrame, documents: DataFrame,
                      cfg: Config) -> DataFrame:
    """(req_id, page_id, is_md, representation, status, reason, varies_on_accept).

    `.md` route: 404 when unresolved or refused, 503 when no document, else 200
    Markdown.  Canonical request: with negotiation on, a safe method and a servable
    page, the answer varies on Accept and is Markdown when preferred (503 without a
    document); otherwise HTML (status NULL: not decided here).

    Decisions are made once for each distinct (route, method, Accept)."""
    r = _routed(requests)
    keys = [*_route_keys(requests), "method", "accept"]
    rr = _resolve(r.select(*keys).distinct(), pages, cfg).join(page_states(servable, documents), "page_id", "left")
    return _attach(r, _decide(rr, cfg).select(*keys, *DECISION), keys).select("req_id", "page_id", "is_md", *DECISION[1:])


#: What is decided for a request.
DECISION = ["page_id", "representation", "status", "reason", "varies_on_accept"]


def page_states(servable: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, deny_reason, known, has_doc of each page with metadata."""
    return (servable.select("page_id", "deny_reason", F.lit(True).alias("known"))
            .join(documents.select("page_id").distinct().withColumn("has_doc", F.lit(True)), "page_id", "left"))


def _decide(rr: DataFrame, cfg: Config) -> DataFrame:
    """Rows with is_md, method, accept, page_id and its state, with DECISION's columns."""
    rr = rr.withColumn("_ranges", accept_ranges(F.col("accept")))
    rr = rr.withColumn("wants", markdown_preferred(F.col("_ranges"), cfg.accept_markdown_wildcards))
    servable_now = F.col("page_id").isNotNull() & F.coalesce(F.col("known"), F.lit(False)) & F.col("deny_reason").isNull()
    safe = F.coalesce(F.upper(F.col("method")).isin("GET", "HEAD"), F.lit(False))
    rr = rr.withColumns({"ok": servable_now, "has_doc": F.coalesce(F.col("has_doc"), F.lit(False)),
                         "negotiate": F.lit(bool(cfg.enable_content_negotiation)) & ~F.col("is_md") & safe & servable_now})
    md, ok, has_doc, neg, wants = (F.col(c) for c in ("is_md", "ok", "has_doc", "negotiate", "wants"))
    representation = (F.when(md & ok & has_doc, F.lit("markdown"))
                      .when(md, F.lit("error"))
                      .when(neg & wants & has_doc, F.lit("markdown"))
                      .when(neg & wants, F.lit("error"))
                      .otherwise(F.lit("html")))
    status = (F.when(md & ~ok, F.lit(404))
              .when(md & ~has_doc, F.lit(503))
              .when(md, F.lit(200))
              .when(neg & wants & ~has_doc, F.lit(503))
              .when(neg & wants, F.lit(200)))
    reason = (F.when(md & F.col("page_id").isNull(), F.lit("unresolved"))
              .when(md & ~ok, F.coalesce("deny_reason", F.lit("no_metadata")))
              .when((md | (neg & wants)) & ~has_doc, F.lit("no_document")))
    return rr.withColumns({"representation": representation, "status": status.cast("int"), "reason": reason, "varies_on_accept": neg})


# ---------------------------------------------------------------------------
# Routes and page states as stored tables, for requests that come as a stream.

def write_route_index(pages: DataFrame, servable: DataFrame, documents: DataFrame, path: str) -> None:
    """Store what decisions need of the pages: routes, and page states."""
    page_routes(pages).write.mode("overwrite").parquet(f"{path}/routes")
    page_states(servable, documents).write.mode("overwrite").parquet(f"{path}/states")


def read_route_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema("route_host string, route string, routed_id long").parquet(f"{path}/routes"),
            spark.read.schema("page_id long, deny_reason string, known boolean, has_doc boolean").parquet(f"{path}/states"))


def _salted(small: DataFrame) -> DataFrame:
    """A row for each salt.  Never broadcast: a stream's plan goes by the size of the files, which says
    nothing of SALTS rows for each of theirs in memory."""
    return small.withColumn("_small_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def classify_rows(requests: DataFrame, routes: DataFrame, states: DataFrame, cfg: Config) -> DataFrame:
    """classify_requests row by row, from stored routes and states: joins with tables at rest alone, so
    `requests` can be a stream.  Requests are spread over SALTS tasks a route and page, as nothing
    gathers them to distinct ones first."""
    r = _routed(requests).withColumn("_salt", F.pmod(F.xxhash64("req_id"), F.lit(SALTS)).cast("int"))
    if "host" in requests.columns:
        on = (T_lower(F.col("host")) == F.col("route_host")) & (F.col("route_key") == F.col("route"))
    else:
        routes = routes.groupBy("route").agg(F.min("routed_id").alias("routed_id"))
        on = F.col("route_key") == F.col("route")
    rr = r.join(_salted(routes), on & (F.col("_salt") == F.col("_small_salt")), "left").drop("_small_salt")
    front = _front_page(cfg, F.col("site_id") if "site_id" in requests.columns else None)
    page = F.col("routed_id")
    if front is not None:
        page = F.when(F.col("route_key").isin("", INDEX), F.coalesce(front, page)).otherwise(page)
    rr = rr.withColumn("page_id", page)
    states = _salted(states.withColumnRenamed("page_id", "_state_page"))
    rr = rr.join(states, (F.col("page_id") == F.col("_state_page")) & (F.col("_salt") == F.col("_small_salt")), "left")
    return _decide(rr, cfg).select("req_id", "page_id", "is_md", *DECISION[1:])
