"""Benchmark: headline jobs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS].  Prints one JSON line.

Queries:
  convert_pages      cold conversion of every page (tokens -> Markdown + front matter)
  refresh_none       incremental refresh against a store holding every page (0 stale)
  refresh_10pct      incremental refresh with 10% of pages stale
  classify_requests  request decisions over the events-derived request log
  markdown_body      conversion body only (no metadata)
Each query is materialised with a full write to the shared scratch folder (noop
sink), so all rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pagemill.config import Config  # noqa: E402
from pagemill.operators import requests as RQ  # noqa: E402
from pagemill.operators import access as AC  # noqa: E402
from pagemill.plans.convert import html_to_markdown  # noqa: E402
from pagemill.plans.pipeline import convert_pages, refresh_documents  # noqa: E402
from pagemill.session import local_session, scratch_dir  # noqa: E402
from pagemill.sources import fixtures as FX  # noqa: E402
from pagemill.sources.pages import read_table  # noqa: E402


def run(make) -> float:
    """Seconds to plan, prepare (some jobs write tables of their own first) and compute a query."""
    t = time.time()
    make().write.format("noop").mode("overwrite").save()
    return time.time() - t


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) * 2, app="pagemill-bench")
    cfg = Config()
    pages = read_table(spark, sf, "pages").select("page_id", "url", "html")
    meta = FX.pages_meta(spark, sf)
    terms = FX.terms(spark, sf)
    n_pages = pages.count()
    n_chars = pages.agg(F.sum(F.length("html"))).first()[0]
    as_of = F.to_timestamp(F.lit(FX.AS_OF))
    q = {}
    # Warm-up on the smallest scale so JIT / codegen costs are not charged to one query.
    run(lambda: convert_pages(read_table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "url", "html"),
                      FX.pages_meta(spark, "/root/testdata/sf0.001"), cfg, FX.terms(spark, "/root/testdata/sf0.001")))
    q["convert_pages"] = run(lambda: convert_pages(pages, meta, cfg, terms, as_of))
    q["markdown_body"] = run(lambda: html_to_markdown(pages, cfg))
    # A store holding every page, written once to the shared scratch folder.
    store_path = scratch_dir(spark, "bench-store")
    convert_pages(pages, meta, cfg, terms, as_of).filter(F.col("fail_reason").isNull()).drop("fail_reason") \
        .write.mode("overwrite").parquet(store_path)
    store = spark.read.parquet(store_path)
    q["refresh_none"] = run(lambda: refresh_documents(pages, meta, store, cfg, as_of, terms))
    stale_store = store.filter(F.pmod(F.xxhash64("page_id"), F.lit(10)) != 0)
    q["refresh_10pct"] = run(lambda: refresh_documents(pages, meta, stale_store, cfg, as_of, terms))
    servable = AC.servable_pages(meta, FX.page_flags(spark, sf), cfg)
    q["classify_requests"] = run(lambda: RQ.classify_requests(FX.requests(spark, sf), pages, servable, store,
                                                      cfg.replace(enable_content_negotiation=True)))
    total = sum(q.values())
    print(json.dumps({"metric": "total_sec", "value": round(total, 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in q.items()},
                      "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "pages": n_pages, "chars": n_chars,
                      "pages_per_sec_cold": round(n_pages / q["convert_pages"], 1),
                      "chars_per_sec_cold": round(n_chars / q["convert_pages"], 1),
                      "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()
