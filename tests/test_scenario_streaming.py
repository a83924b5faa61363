import datetime as dt
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.streams import as_stream
from marketloom.operators import scenario as sc
from marketloom.session import scratch_path
from marketloom.sources.lake import LakeTable
from marketloom.streaming import ingest

PRICES = [100, 101, 100.5, 101.7, 102.1, 101.8, 102.4, 103]


def inputs(spark, drift=0.001, vol=0.02, n=1):
    return spark.createDataFrame([(a, 100.0, drift, vol) for a in range(n)],
                                 "asset_id long, starting_price double, daily_drift double, daily_volatility double")


def test_inputs(prices):
    row = sc.scenario_inputs(prices(PRICES)).first()
    r = np.array(PRICES[1:]) / np.array(PRICES[:-1]) - 1
    assert row.starting_price == 103 and row.daily_drift == pytest.approx(r.mean()) and row.daily_volatility == pytest.approx(r.std(ddof=1))
    assert row.annualized_volatility == pytest.approx(r.std(ddof=1) * math.sqrt(252)) and row.observations == 7
    assert sc.scenario_inputs(prices([100, 101])).count() == 0


def test_forecast_inputs(spark):
    f = spark.createDataFrame([(0, 20, 0.04, 0.3, 0.32, 0.5), (1, 10, None, None, None, 0.05)],
                              "asset_id long, prediction_horizon_days int, predicted_return_20d double, downside_probability_20d double, "
                              "predicted_volatility_20d double, downside_volatility_20d double")
    got = {r.asset_id: r for r in sc.forecast_inputs(inputs(spark, n=3), f).collect()}
    assert got[0].daily_drift == pytest.approx(0.002) and got[0].daily_volatility == pytest.approx(0.32 / math.sqrt(252))
    assert got[1].daily_drift == 0.001 and got[1].daily_volatility == 0.05
    assert got[2].daily_volatility == 0.02 and got[2].forecast_horizon_days is None


def test_stream_drops_late_days(spark):
    day = [dt.datetime(2026, 1, d, 12) for d in (1, 2, 9, 10, 1)]
    schema = "asset_id long, published_at timestamp, sentiment_score double, sentiment_label string"
    landing = scratch_path(spark, "landing")
    for i, t in enumerate(day):  # one file, hence one micro-batch, per day; the last one is late
        spark.createDataFrame([(1, t, 0.5, "positive")], schema).coalesce(1).write.mode("append").parquet(landing)
        time.sleep(1.1)  # file order follows modification time
    stream = ingest.daily_sentiment_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing))
    out = scratch_path(spark, "out")
    ingest.append_to(stream, out, scratch_path(spark, "ck")).awaitTermination()
    got = {r.feature_date.day: r.article_count_1d for r in spark.read.schema(stream.schema).parquet(out).collect()}
    assert got == {1: 1, 2: 1}


def test_stream_state_keeps_last_success(spark):
    rows = spark.range(40).select(
        F.lit("A").alias("ticker"), F.lit("p").alias("provider_name"), F.col("id").alias("run_id"),
        F.timestamp_seconds("id").alias("started_at"), F.when(F.col("id") < 30, "success").otherwise("timeout").alias("fetch_status"),
        F.lit("slow").alias("error_message"), F.col("id").alias("record_count_fetched"), F.lit("stock").alias("asset_type"),
        F.lit(dt.date(2026, 1, 1)).alias("coverage_start_date"), F.lit(dt.date(2026, 1, 2)).alias("coverage_end_date"))
    q = (ingest.running_state(as_stream(rows)).writeStream.outputMode("complete").format("memory").queryName("state")
         .option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    row, = spark.sql("select * from state").collect()
    assert (row.record_count_fetched, row.fetch_status, row.error_message) == (29, "timeout", "slow")


T0 = dt.datetime(2026, 1, 5)


def articles(spark, rows):
    """(provider id, url, headline, day)"""
    return spark.createDataFrame([(1, 1, i, u, h, T0, T0 + dt.timedelta(days=d)) for i, u, h, d in rows],
                                 "asset_id long, source_id long, provider_article_id string, url string, headline string, published_at timestamp, "
                                 "ingestion_timestamp timestamp")


def test_bulk_load_and_streams_keep_each_others_rows(spark):
    def bars(ids):
        return spark.createDataFrame([(i, 1, dt.date(2026, 1, 2), float(i), T0) for i in ids],
                                     "asset_id long, source_id long, price_date date, close_price double, ingestion_timestamp timestamp")
    table = LakeTable(spark, scratch_path(spark, "lake"), "historical_prices", ["ingestion_timestamp"])
    table.write_batch(bars(range(50)), 0)
    known = spark.range(130).select(F.col("id").alias("asset_id"))
    for ids in (range(50, 100), range(100, 150)):
        ingest.ingest_bars(as_stream(bars(ids)), table, scratch_path(spark, "ck"), known).awaitTermination()
    assert sorted(r.asset_id for r in table.current().collect()) == list(range(130))
    again = LakeTable(spark, table.root, table.name, table.order)
    again.compact(scratch_path(spark, "snapshot"))
    later = LakeTable(spark, table.root, table.name, table.order)
    assert later.snapshot and later.batches().count() == 0 and later.current().count() == 130
    assert later.next_batch() == 1


def test_corrected_and_late_articles_replace_the_stored_ones(spark):
    table = LakeTable(spark, scratch_path(spark, "lake"), "news_articles", ["ingestion_timestamp"])
    first = [(f"p{i}", f"u{i}", "old", 0) for i in range(20)] + [(None, "plain", "old", 0)]
    for rows in (first, [("p1", "u1", "corrected", 40), ("p2", "moved", "new url", 40), (None, "plain", "corrected", 40)]):
        ingest.ingest_news(as_stream(articles(spark, rows), files=1), table, scratch_path(spark, "ck")).awaitTermination()

    def state(t):
        return {r.url: (r.provider_article_id, r.headline) for r in t.current().collect()}
    got = state(table)
    assert len(got) == 21 and got["u1"] == ("p1", "corrected") and got["moved"] == ("p2", "new url") and "u2" not in got and got["plain"][1] == "corrected"
    folded = table.compact(scratch_path(spark, "snapshot"))
    assert state(folded) == got
    folded.write_batch(articles(spark, [("p3", "u3b", "third url", 50)]), folded.next_batch())
    after = state(folded)
    assert len(after) == 21 and "u3" not in after and after["u3b"] == ("p3", "third url")
