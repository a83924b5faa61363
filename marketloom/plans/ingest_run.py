"""Ingest of a whole universe as one job: normalize, reject, upsert, ingestion state and run log."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.upsert import assign_ids, ingestion_state, merged_state, upsert_assets, upsert_sources
from marketloom.session import materialize
from marketloom.sources.lake import LakeTable
from marketloom.sources.normalize import normalize_feeds, normalize_metadata, parse_bars

# the latest bar of a key wins, then the larger values: equal stamps inside a batch have one winner too
PRICE_ORDER = ["ingestion_timestamp", "close_price", "volume", "high_price", "low_price", "open_price", "adjusted_close"]
RAW_BAR = ["date", "open", "high", "low", "close", "adj_close", "volume"]
NEWS_ORDER = ["ingestion_timestamp", "published_at", "headline"]
STATE_ORDER = ["updated_at"]


@dataclass(frozen=True)
class Provider:
    name: str
    kind: str = "market_data"
    url: str | None = None


def _table(spark, root, name, order=(), writer="bulk") -> LakeTable:
    return LakeTable(spark, root, name, list(order), writer)


def _stamp(at: datetime):
    return F.lit(at).cast("timestamp")


def _code(column):
    return F.upper(F.trim(column))


def register_source(spark: SparkSession, root: str, provider: Provider, at: datetime, batch_id: int, writer: str = "bulk") -> int:
    """The provider's id: its own if it is known, else the next free one. Its type and url are updated."""
    table = _table(spark, root, "data_sources", ["updated_at"], writer)
    new = spark.createDataFrame([(provider.name, provider.kind, provider.url, at, at)],
                                "source_name string, source_type string, source_url string, created_at timestamp, updated_at timestamp")
    merged = assign_ids(upsert_sources(table.current_or_empty(), new), "source_id", "source_name")
    # read before the batch folder is written: a repeated batch replaces what it reads
    own = materialize(merged.where(F.col("source_name") == provider.name.strip()), "source")
    table.write_batch(own, batch_id)
    return own.first()["source_id"]


def store_metadata(spark: SparkSession, root: str, raw: DataFrame, source_id: int, at: datetime, batch_id: int, writer: str = "bulk") -> None:
    """Upserts the assets that ``raw`` names; new ones get the next free ids."""
    table = _table(spark, root, "assets", ["updated_at"], writer)
    records = normalize_metadata(raw).where(F.length("ticker") > 0)
    merged = assign_ids(upsert_assets(table.current_or_empty(), records, source_id))
    touched = merged.join(records.select("ticker"), "ticker", "left_semi").withColumns({"created_at": _stamp(at), "updated_at": _stamp(at)})
    table.write_batch(materialize(touched, "assets"), batch_id)


def _rejected(rows: DataFrame, table: str, provider: Provider, at: datetime, columns: list[str]) -> DataFrame:
    return rows.where(F.col("reason").isNotNull()).select(
        F.lit(table).alias("table_name"), F.lit(provider.name).alias("provider_name"), "ticker", "reason",
        F.to_json(F.struct(*columns)).alias("row_json"), _stamp(at).alias("rejected_at"))


def _run_log(stored: DataFrame, rejected: DataFrame, failures: DataFrame | None, assets: DataFrame, provider: Provider,
             at: datetime, cache_status: str) -> DataFrame:
    """One row per ticker of the batch: what was fetched and stored, or why nothing was."""
    done = stored.groupBy("asset_id").agg(
        F.count("*").alias("n"), F.min("price_date").alias("coverage_start_date"), F.max("price_date").alias("coverage_end_date"))
    loaded = done.join(assets, "asset_id").select(
        "ticker", F.col("asset_class").alias("asset_type"), F.lit("success").alias("fetch_status"),
        F.lit(None).cast("string").alias("error_message"), F.col("n").alias("record_count_fetched"),
        F.col("n").alias("records_written"), "coverage_start_date", "coverage_end_date", _stamp(at).alias("started_at"))
    strangers = F.count_if(F.col("reason") == "unknown_asset")
    empty = (rejected.where(F.length("ticker") > 0).groupBy("ticker").agg(strangers.alias("n"))
             .join(loaded.select("ticker"), "ticker", "left_anti")
             .select("ticker", F.when(F.col("n") > 0, "unknown_asset").otherwise("empty_response").alias("fetch_status"),
                     F.when(F.col("n") > 0, "no asset of this ticker is stored").otherwise("no row with a date and a close").alias("error_message"),
                     F.col("n").alias("record_count_fetched"), F.lit(0).cast("long").alias("records_written"), _stamp(at).alias("started_at")))
    log = loaded.unionByName(empty, allowMissingColumns=True)
    if failures is not None:
        begun = F.col("started_at") if "started_at" in failures.columns else _stamp(at)
        log = log.unionByName(failures.select(
            _code("ticker").alias("ticker"), "fetch_status", "error_message", begun.alias("started_at")), allowMissingColumns=True)
    return log.withColumns({
        "provider_name": F.lit(provider.name), "completed_at": F.current_timestamp(), "cache_status": F.lit(cache_status)})


def ingest_market_batch(spark: SparkSession, root: str, raw_bars: DataFrame, provider: Provider, started_at: datetime,
                        raw_metadata: DataFrame | None = None, failures: DataFrame | None = None, batch_id: int | None = None,
                        writer: str = "bulk", cache_status: str = "refreshed") -> dict:
    """Loads one batch of raw bars (``ticker``, ``date``, OHLCV) of any number of tickers and logs it.

    ``raw_metadata`` is stored first, so that its tickers are known. Bars without a ticker, close or date, or of an asset that is
    not stored, go to ``rejected_rows`` with the reason and the row as it came. ``failures`` (``ticker``, ``fetch_status``,
    ``error_message``) are requests that brought no rows. The run log gets one row per ticker, the ingestion state follows from it.

    The counts returned are observed while the bars are written. Repeating a ``batch_id`` replaces the batch. Ids are given by one
    job at a time: two jobs must not bring new sources or assets to one root at once.
    """
    prices = _table(spark, root, "historical_prices", PRICE_ORDER, writer)
    logs = _table(spark, root, "ingestion_run_logs", writer=writer)
    if batch_id is None:
        batch_id = max(prices.next_batch(), logs.next_batch())
    source_id = register_source(spark, root, provider, started_at, batch_id, writer)
    if raw_metadata is not None:
        store_metadata(spark, root, raw_metadata, source_id, started_at, batch_id, writer)
    assets = _table(spark, root, "assets", ["updated_at"], writer).current_or_empty().select("asset_id", "ticker", "asset_class")

    bars = parse_bars(raw_bars.select("ticker", *RAW_BAR)).withColumn("ticker", _code("ticker"))
    reason = (F.when(F.coalesce(F.length("ticker"), F.lit(0)) == 0, "missing_ticker").when(F.col("close_price").isNull(), "missing_close")
              .when(F.col("price_date").isNull(), "missing_date").when(F.col("asset_id").isNull(), "unknown_asset"))
    judged = bars.join(assets.select("asset_id", "ticker"), "ticker", "left").withColumn("reason", reason)
    seen = Observation("bars")
    counted = judged.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("reason").isNull()).alias("accepted"),
                             F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    prices.write_batch(counted.where(F.col("reason").isNull()).withColumns({
        "source_id": F.lit(source_id).cast("long"), "ingestion_timestamp": _stamp(started_at), "created_at": _stamp(started_at)}), batch_id)
    rejects = _table(spark, root, "rejected_rows", writer=writer)
    rejects.write_batch(_rejected(judged, "historical_prices", provider, started_at, bars.columns), batch_id)

    logs.write_batch(_run_log(prices.read_batch(batch_id), rejects.read_batch(batch_id), failures, assets, provider, started_at,
                              cache_status), batch_id)
    store_state(spark, root, logs.read_batch(batch_id), batch_id, writer)
    return {"batch_id": batch_id, "source_id": source_id, **seen.get}


def store_state(spark: SparkSession, root: str, log: DataFrame, batch_id: int, writer: str = "bulk") -> None:
    """State of the tickers in ``log``, on top of what is stored of them."""
    table = _table(spark, root, "market_data_ingestion_state", STATE_ORDER, writer)
    fresh = ingestion_state(log)
    before = table.current_or_empty().join(fresh.select("ticker", "provider_name"), ["ticker", "provider_name"], "left_semi")
    table.write_batch(materialize(merged_state(before, fresh), "state"), batch_id)


def ingest_news_batch(spark: SparkSession, root: str, raw: DataFrame, provider: Provider, started_at: datetime,
                      batch_id: int | None = None, writer: str = "bulk", **lexicon) -> dict:
    """Loads raw feed payloads (``ticker``, ``shape``, ``payload``) as scored articles; versions of one article resolve on read.

    Payloads without headline, url or time, and those of assets that are not stored, go to ``rejected_rows``.
    """
    table = _table(spark, root, "news_articles", NEWS_ORDER, writer)
    rejects = _table(spark, root, "rejected_rows", writer=f"{writer}-news")
    if batch_id is None:
        batch_id = max(table.next_batch(), rejects.next_batch())
    source_id = register_source(spark, root, provider, started_at, batch_id, f"{writer}-news")
    assets = _table(spark, root, "assets", ["updated_at"]).current_or_empty().select("asset_id", "ticker")
    articles = normalize_feeds(raw.select(_code("ticker").alias("ticker"), "shape", "payload"), keep_unusable=True, **lexicon)
    unusable = F.col("headline").isNull() | F.col("url").isNull() | F.col("published_at").isNull()
    judged = articles.join(assets, "ticker", "left").withColumn(
        "reason", F.when(unusable, "unusable_article").when(F.col("asset_id").isNull(), "unknown_asset"))
    seen = Observation("articles")
    counted = judged.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("reason").isNull()).alias("accepted"),
                             F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    accepted = counted.where(F.col("reason").isNull()).withColumns({
        "source_id": F.lit(source_id).cast("long"), "ingestion_timestamp": _stamp(started_at), "created_at": _stamp(started_at)})
    table.write_batch(accepted.drop("reason", "ticker", "shape"), batch_id)
    rejects.write_batch(_rejected(judged, "news_articles", provider, started_at, articles.columns), batch_id)
    return {"batch_id": batch_id, "source_id": source_id, **seen.get}
