"""Checks of the streaming jobs: each drains a file stream of several files and is compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check
from marketloom.session import scratch_path
from marketloom.sources import demo_universe as u
from marketloom.sources.lake import LakeTable
from marketloom.streaming import ingest


def as_stream(df, files: int = 4, order: str | None = None):
    """The whole of ``df`` as a file stream, a few files per micro-batch, in time order if asked."""
    spark = df.sparkSession
    path = scratch_path(spark, "landing")
    (df.repartitionByRange(files, order) if order else df.repartition(files)).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@check("r01_stream_bars", """
select asset_id, source_id, price_date, volume, ingestion_timestamp from x_feed""")
def _(spark, sf):
    """Some assets are loaded in bulk, the others come by two streams: no writer may touch what another wrote."""
    bars = u.historical_prices(spark, sf)
    table = LakeTable(spark, scratch_path(spark, "lake"), "historical_prices", ["ingestion_timestamp"])
    table.write_batch(bars.where("asset_id % 3 = 0"), 0)
    for rest in (1, 2):
        ingest.ingest_bars(as_stream(bars.where(F.col("asset_id") % 3 == rest)), table, scratch_path(spark, "checkpoint")).awaitTermination()
    return table.current().select("asset_id", "source_id", "price_date", "volume", "ingestion_timestamp")


@check("r02_stream_news", """
select asset_id, source_id, case when day(published_at) % 2 = 0 then url || '/moved' else url end as url,
  case when day(published_at) % 3 = 0 then 'Correction: ' else '' end || headline as headline, published_at, provider_article_id from x_article""")
def _(spark, sf):
    """Originals, then repeats: some corrected, some under a new url with the same provider id; all of them old."""
    once = u.news_articles(spark, sf)
    day = F.dayofmonth("published_at")
    again = once.withColumns({
        "headline": F.when(day % 3 == 0, F.concat(F.lit("Correction: "), "headline")).otherwise(F.col("headline")),
        "url": F.when(day % 2 == 0, F.concat("url", F.lit("/moved"))).otherwise(F.col("url")),
        "ingestion_timestamp": F.timestamp_add("DAY", F.lit(90), F.col("ingestion_timestamp"))})
    table = LakeTable(spark, scratch_path(spark, "lake"), "news_articles", ["ingestion_timestamp"])
    ingest.ingest_news(as_stream(once.unionByName(again)), table, scratch_path(spark, "checkpoint")).awaitTermination()
    return table.current().select("asset_id", "source_id", "url", "headline", "published_at", "provider_article_id")


@check("r03_stream_daily_sentiment", """
select asset_id, published_at::date as feature_date, count(*) as article_count_1d,
  sum(sentiment_score::decimal(18,10))::double / count(*) as sentiment_mean_1d,
  count(*) filter (sentiment_label = 'negative')::double / count(*) as negative_article_share_1d,
  count(*) filter (sentiment_label = 'positive')::double / count(*) as positive_article_share_1d
from x_article group by 1, 2 having feature_date::timestamp + interval 1 day <=
  (select max(published_at) - interval 2 day from x_article)""",
       rounds="sentiment_mean_1d negative_article_share_1d positive_article_share_1d")
def _(spark, sf):
    stream = ingest.daily_sentiment_stream(as_stream(u.news_articles(spark, sf), order="published_at"))
    out = scratch_path(spark, "daily")
    ingest.append_to(stream, out, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@check("r04_stream_state", """
select ticker, provider_name, last_successful_fetch_at, request_timestamp, fetch_status, record_count_fetched,
       coverage_end_date, nullif(error_text, '') as error_message, created_at from x_state""")
def _(spark, sf):
    table = LakeTable(spark, scratch_path(spark, "lake"), "market_data_ingestion_state", [])
    state = ingest.running_state(as_stream(u.ingestion_runs(spark, sf)))
    ingest.upsert_state(state, table, scratch_path(spark, "checkpoint")).awaitTermination()
    return table.current().select("ticker", "provider_name", "last_successful_fetch_at", "request_timestamp", "fetch_status",
                                  "record_count_fetched", "coverage_end_date", "error_message", "created_at")
