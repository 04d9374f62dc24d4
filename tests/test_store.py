"""The written store, the stream's state, and requests as a stream."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import functions as F

from pagemill.config import Config
from pagemill.operators import store as ST
from pagemill.plans.pipeline import convert_pages, refresh_documents, refresh_store
from pagemill.sources import fixtures as FX
from pagemill.sources import parts as PT

from .conftest import SF


def listing(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("part-*")}


def folders(files):
    return {os.path.dirname(f) for f in files}


def test_refresh_and_purge_touch_only_their_folders(spark, tmp_path):
    cfg, as_of = Config(), F.to_timestamp(F.lit(FX.AS_OF))
    pages = spark.read.parquet(f"{SF}/pages.parquet").filter("page_id < 40").cache()
    meta = FX.pages_meta(spark, SF).filter("page_id < 40").cache()
    store = str(tmp_path / "store")
    whole = convert_pages(pages, meta, cfg, as_of=as_of).filter("fail_reason is null").drop("fail_reason")
    ST.write_store(whole, store)
    first, rows = listing(store), {r.page_id: r for r in ST.read_store(spark, store).collect()}
    assert refresh_store(pages, meta, store, cfg, as_of) == [] and listing(store) == first

    # Two pages change, one goes: their three folders alone are written or removed.
    changed = pages.filter("page_id <> 9").withColumn("html", F.when(F.col("page_id").isin(3, 4), F.lit("<article><p>new</p></article>")).otherwise(F.col("html")))
    parts = refresh_store(changed, meta.filter("page_id <> 9"), store, cfg, as_of)
    want = {(rows[i].site_id, rows[i].bucket) for i in (3, 4, 9)}
    assert set(parts) == want
    second = listing(store)
    moved = folders({f for f in first.keys() | second.keys() if first.get(f) != second.get(f)})
    assert moved == {f"site_id={s}/bucket={b}" for s, b in want}
    got = {r.page_id: r.document for r in ST.read_store(spark, store).collect()}
    assert set(got) == set(rows) - {9} and "new" in got[3] and all(got[i] == rows[i].document for i in got if i not in (3, 4))
    # The same as the snapshot of the whole.
    snapshot = refresh_documents(changed, meta.filter("page_id <> 9"), whole, cfg, as_of).select("page_id", "document")
    assert {r.page_id: r.document for r in snapshot.collect()} == got

    ST.purge_store(spark, store, [2, 77])
    third = listing(store)
    assert third == {f: t for f, t in second.items() if not f.startswith("site_id=2/")}
    assert {r.page_id for r in ST.read_store(spark, store).collect()} == {i for i in got if rows[i].site_id != 2}


def test_parts_with_null_values_and_emptied_parts(spark, tmp_path):
    path, by = str(tmp_path / "t"), ("site_id", "bucket")
    schema = "k long, site_id long, bucket int"
    PT.write_parts(spark.createDataFrame([(1, None, 0), (2, 5, 1), (3, 5, 2)], schema), path, by)
    part = PT.read_parts(spark, path, schema, by, [(None, 0), (5, 1), (8, 8)])
    assert sorted(r.k for r in part.collect()) == [1, 2] and PT.touched(part.filter("k = 1"), by) == [(None, 0)]
    PT.replace_parts(part.filter("k = 1").withColumn("k", F.lit(7).cast("long")), path, by, [(None, 0), (5, 1)])
    assert sorted(r.k for r in PT.read_parts(spark, path, schema, by).collect()) == [3, 7]
    assert not (tmp_path / "t" / "site_id=5" / "bucket=1").exists()


def test_lapsed_rows_are_those_not_live(spark):
    as_of = F.to_timestamp(F.lit("2020-01-02 00:00:00"))
    rows = [(None, "f", "2020-01-01 23:00:00", "d"), (1, "f", "2020-01-01 23:00:00", "d"), (1, "f", "2019-01-01 00:00:00", "d"),
            (2, None, None, "d"), (3, "f", "2020-01-01 23:00:00", ""), (4, "f", "2020-01-03 00:00:00", "d")]
    store = spark.createDataFrame(rows, "page_id long, fingerprint string, at string, document string").withColumn("converted_at", F.to_timestamp("at"))
    live, lapsed = (f(store, as_of, Config()) for f in (ST.live_documents, ST.expire_documents))
    assert sorted(map(str, (r.page_id for r in live.collect()))) == ["1", "None"]
    assert live.unionByName(lapsed).exceptAll(store).count() == 0 and lapsed.count() == 4


def test_stream_state(spark, tmp_path):
    """One state row a page however many batches; replays give the same; unchanged pages wait for their TTL."""
    from pagemill.streaming import stream as S
    cfg, out = Config(cache_ttl_seconds=3600), str(tmp_path / "out")
    meta = FX.pages_meta(spark, SF)

    def at(hour):
        return F.to_timestamp(F.lit(f"2024-01-01 {hour:02d}:00:00"))

    def batch(i, rows, hour):
        df = spark.createDataFrame([(p, f"http://t/{p}", h) for p, h in rows], "page_id long, url string, html string")
        S._convert_batch(df, meta, cfg, None, out, i, at(hour))
        return spark.read.parquet(f"{out}/batch={i}").count()

    def current():
        return {r.page_id: r.body for r in S.current_documents(spark, out).collect()}

    def page(text):
        return f"<article><p>{text}</p></article>"
    assert batch(0, [(1, page("a")), (2, page("b")), (3, "<article> </article>")], 1) == 3
    assert batch(1, [(1, page("a")), (2, page("c"))], 1) == 1
    assert batch(1, [(1, page("a")), (2, page("c"))], 1) == 1  # replayed after it had written its state
    assert current() == {1: "a", 2: "c", 3: None}
    assert batch(2, [(2, page("b"))], 1) == 1 and current()[2] == "b"  # back to an earlier text
    assert batch(3, [(1, page("a")), (3, "<article> </article>")], 1) == 1  # a failure is tried again
    assert batch(4, [(1, page("a"))], 3) == 1  # its TTL has passed
    state = PT.read_parts(spark, S._state_dir(out), S.STATE_SCHEMA, S.STATE_PARTS)
    assert sorted((r.page_id, r.batch) for r in state.collect()) == [(1, 4), (2, 2), (3, 3)]


def test_requests_row_by_row(spark, tmp_path):
    """Stored routes give the decisions that the whole tables give, on several hosts, with front pages by site."""
    from pagemill.operators import requests as RQ
    cfg = Config(enable_content_negotiation=True, site_front_page_id=((1, 11),))
    pages = spark.createDataFrame([(10, "http://a.t/x", ""), (11, "http://a.t/", ""), (12, "http://b.t/x", ""), (13, "http://b.t/index", "")], "page_id long, url string, html string")
    servable = spark.createDataFrame([(10, None), (11, None), (12, "noindex"), (13, None)], "page_id long, deny_reason string")
    docs = spark.createDataFrame([(10,), (13,)], "page_id long")
    rows, i = [], 0
    for host, site in (("A.t", 1), ("b.t", 2), ("c.t", None)):
        for path in ("/x.md", "/x", "/", "/index.md", "/none.md", None):
            for accept in ("text/markdown", "text/html", None):
                rows.append((i := i + 1, host, site, path, "GET", accept))
    requests = spark.createDataFrame(rows * 1, "req_id long, host string, site_id long, path string, method string, accept string")
    RQ.write_route_index(pages, servable, docs, str(tmp_path / "index"))
    for reqs in (requests, requests.drop("host")):
        whole = RQ.classify_requests(reqs, pages, servable, docs, cfg)
        by_row = RQ.classify_rows(reqs, *RQ.read_route_index(spark, str(tmp_path / "index")), cfg)
        assert by_row.columns == whole.columns and sorted(map(str, by_row.collect())) == sorted(map(str, whole.collect()))


def test_saved_routes_stay_in_their_buckets(spark, tmp_path):
    """Resolving against the saved table moves requests alone."""
    from pagemill.operators import requests as RQ
    pages = spark.createDataFrame([(i, f"http://{'ab'[i % 2]}.t/p{i // 3}", "") for i in range(60)] + [(90, "http://a.t/", "")], "page_id long, url string, html string")
    requests = spark.createDataFrame([(i, f"{'aB'[i % 2]}.t", f"/p{i % 25}{'.md' * (i % 3 == 0)}" if i else "/index.md") for i in range(80)], "req_id long, host string, path string")
    RQ.save_routes(pages, "routes_test", str(tmp_path / "routes"), 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        routes = RQ.saved_routes(spark, "routes_test")
        by_table = RQ.resolve_requests(requests, None, Config(), routes)
        assert sorted(map(str, by_table.collect())) == sorted(map(str, RQ.resolve_requests(requests, pages, Config()).collect()))
        keys = RQ._routed(requests).select("host", "is_md", "route_key").distinct()
        spark.conf.set("spark.sql.adaptive.enabled", "false")

        def exchanges(df):
            return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        # Two for the requests (distinct ones, then to the buckets), none for the routes.
        assert exchanges(RQ.saved_routes(spark, "routes_test")) == 0
        assert exchanges(RQ._resolve_routes(keys, routes, Config())) == 2
        assert exchanges(RQ._resolve_routes(keys, RQ.page_routes(pages), Config())) > 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql("DROP TABLE routes_test")
