"""Hot keys: one host, URI or side holding a large share of the rows."""

from pyspark.sql import functions as F

from corpusforge.operators import crawl
from corpusforge.operators import exchange as X


def test_hot_host_is_pre_aggregated(spark):
    n = 30000
    idx = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot.example.com")).otherwise(F.concat(F.lit("h"), (F.col("id") % 997).cast("string"), F.lit(".com"))).alias("url_host_name"),
        F.when(F.col("id") < 5, F.lit("https://hot.example.com/")).otherwise(F.concat(F.lit("http://x/"), F.col("id").cast("string"))).alias("url"),
        F.concat(F.lit("f"), (F.col("id") % 13).cast("string")).alias("warc_filename"),
        F.col("id").alias("warc_record_offset"), F.lit(100).cast("bigint").alias("warc_record_length"),
    )
    hs = crawl.host_summary(idx)
    plan = hs._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_min" in plan  # map-side combine before the shuffle
    hot = hs.where("hostname = 'hot.example.com'").collect()[0]
    assert hot["n"] == n // 3 and hot["n_root"] == 2 and hot["warc_record_offset"] == 0


def test_hot_uri_in_one_archive(spark):
    rows = []
    for g in range(1000):
        for k, t in enumerate(("request", "response", "metadata")):
            rows.append(("arc-0", g * 10 + k, t, "http://hot/", "2017-01-01T00:00:00Z", None, b"x"))
    rows.append(("arc-0", 99999, "request", "http://hot/", "2017-01-01T00:00:00Z", None, b"x"))
    df = spark.createDataFrame(rows, "file string, ordinal long, rec_type string, target_uri string, warc_date string, http_headers string, payload binary")
    assert X.assemble_exchanges(df, on_unpaired="drop").count() == 1000
    rep = X.assemble_exchanges(df, on_unpaired="report").collect()
    assert len(rep) == 1 and rep[0]["generation"] == 1001 and rep[0]["missing"] == ["response", "metadata"]
    assert X.assemble_exchanges(df, on_unpaired="drop").count() == 1000
