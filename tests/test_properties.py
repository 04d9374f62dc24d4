"""Properties over the driver's fixture tables (sf0.001)."""

from pyspark.sql import functions as F

from pagemill.config import Config
from pagemill.operators import tokens as K
from pagemill.plans.convert import html_to_markdown
from pagemill.plans.pipeline import convert_pages, refresh_documents
from pagemill.sources import fixtures as FX
from pagemill.sources.pages import read_table

from .conftest import SF


def test_tokens_are_lossless(spark):
    pages = read_table(spark, SF, "pages")
    t = K.page_tokens(pages).groupBy("page_id").agg(F.sum(F.length("tok")).alias("n"))
    bad = t.join(pages.select("page_id", F.length("html").alias("m")), "page_id").filter("n != m").count()
    assert bad == 0


def test_result_independent_of_partitioning(spark):
    pages = read_table(spark, SF, "pages").select("page_id", "url", "html")
    a = html_to_markdown(pages.repartition(1), Config())
    b = html_to_markdown(pages.repartition(7), Config())
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_every_page_is_a_document_or_a_failure(spark):
    pages = read_table(spark, SF, "pages").select("page_id", "url", "html")
    d = convert_pages(pages, FX.pages_meta(spark, SF), Config(), FX.terms(spark, SF))
    rows = d.collect()
    assert len(rows) == pages.count()
    assert all((r.document is None) == (r.fail_reason is not None) for r in rows)
    assert all(r.document.startswith("---\ntitle: ") and r.document.endswith("\n") for r in rows if r.document)


def test_second_refresh_converts_nothing(spark, tmp_path):
    pages = read_table(spark, SF, "pages").select("page_id", "url", "html")
    meta = FX.pages_meta(spark, SF)
    as_of = F.to_timestamp(F.lit(FX.AS_OF))
    empty = spark.createDataFrame([], convert_pages(pages, meta, Config(), None, as_of)
                                  .drop("fail_reason").schema)
    first = refresh_documents(pages, meta, empty, Config(), as_of)
    first.write.parquet(str(tmp_path / "s1"))
    store = spark.read.parquet(str(tmp_path / "s1"))
    assert store.count() == pages.count()
    from pagemill.operators import store as ST
    fp = meta.join(pages, "page_id").select("page_id", ST.fingerprint(
        F.col("site_id"), F.col("page_id"), F.col("modified_at"), F.col("html"), Config()).alias("fingerprint"))
    assert ST.stale_pages(fp, store, as_of, Config()).count() == 0
    # a new generation makes everything stale
    fp2 = meta.join(pages, "page_id").select("page_id", ST.fingerprint(
        F.col("site_id"), F.col("page_id"), F.col("modified_at"), F.col("html"), Config().bump_generation())
        .alias("fingerprint"))
    assert ST.stale_pages(fp2, store, as_of, Config()).count() == pages.count()
    # entries older than the TTL lapse
    later = F.to_timestamp(F.lit("2024-06-01 13:00:00"))
    assert ST.expire_documents(store, later, Config()).count() == pages.count()


def test_stream_equals_batch(spark):
    from pagemill.streaming.stream import stream_pages
    s = stream_pages(spark, SF, Config()).select("page_id", F.md5("document").alias("h"))
    pages = read_table(spark, SF, "pages").select("page_id", "url", "html")
    b = convert_pages(pages, FX.pages_meta(spark, SF), Config(), FX.terms(spark, SF)) \
        .filter("fail_reason is null").select("page_id", F.md5("document").alias("h"))
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_stream_restart_from_checkpoint(spark, tmp_path):
    """A restarted stream picks up only the files that arrived since its checkpoint;
    every page is converted exactly once."""
    from pagemill.sources.pages import PAGES_SCHEMA
    from pagemill.streaming.stream import convert_stream
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    pages = read_table(spark, SF, "pages").select("page_id", "url", "html")
    meta = FX.pages_meta(spark, SF)
    pages.filter("page_id % 2 = 0").repartition(2).write.parquet(src)

    def run():
        stream = spark.readStream.schema(PAGES_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        convert_stream(stream, meta, Config(), out, ck).awaitTermination()

    run()
    first = spark.read.parquet(out).count()
    pages.filter("page_id % 2 = 1").repartition(2).write.mode("append").parquet(src)
    run()
    res = spark.read.parquet(out)
    assert first == pages.filter("page_id % 2 = 0").count()
    assert res.count() == pages.count() == res.select("page_id").distinct().count()
