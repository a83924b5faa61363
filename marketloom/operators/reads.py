"""Read queries over the stored tables. A ticker is a filter; without one the whole universe is returned.

Dimension joins carry no broadcast hint: Spark broadcasts a side only when its measured size is
below the session threshold, and otherwise falls back to a (skew-split) sort-merge join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import ticker_code
from marketloom.sources.schemas import NEGATIVE_TARGET, RETURN_TARGET, SENTIMENT_COLUMNS, TECHNICAL_COLUMNS


def _only(df: DataFrame, ticker: str | None) -> DataFrame:
    return df if ticker is None else df.where(F.col("ticker") == ticker.strip().upper())


def _between(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def _between_days(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Day range on a timestamp, written as a timestamp range so that it reaches the scan."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date").cast("timestamp"))
    if end is not None:
        df = df.where(F.col(column) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return df


def newest_rows(df: DataFrame, n: int, keys: list[str], newest: list) -> DataFrame:
    """The first ``n`` rows per key. Spark keeps only ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# --- assets -----------------------------------------------------------------------------------

def asset_list(assets: DataFrame, active_only: bool = True) -> DataFrame:
    rows = assets.where("is_active") if active_only else assets
    return rows.select("ticker", "asset_name", "asset_class", "exchange", "currency", "is_active").orderBy("ticker")


def asset_metadata(assets: DataFrame, sources: DataFrame, ticker: str | None = None) -> DataFrame:
    src = sources.select(F.col("source_id").alias("primary_source_id"), F.col("source_name").alias("primary_source"))
    stamps = [c for c in ("created_at", "updated_at") if c in assets.columns]
    return _only(assets, ticker).join(src, "primary_source_id", "left").select(
        "ticker", "asset_name", "asset_class", "exchange", "currency", "sector", "industry", "country",
        "is_active", "primary_source", *stamps)


def asset_labels(assets: DataFrame) -> DataFrame:
    return assets.select("ticker", F.concat_ws(" | ", "ticker", "asset_name").alias("label"), "asset_name",
                         "asset_class", "exchange", "currency").orderBy("ticker")


# --- prices -----------------------------------------------------------------------------------

def price_history(prices: DataFrame, assets: DataFrame, sources: DataFrame, ticker: str | None = None,
                  start=None, end=None, limit: int | None = None) -> DataFrame:
    rows = (_between(prices, "price_date", start, end)
            .join(_only(assets, ticker).select("asset_id", "ticker"), "asset_id")
            .join(sources.select("source_id", "source_name"), "source_id")
            .select("ticker", "price_date", "open_price", "high_price", "low_price", "close_price",
                    "adjusted_close", "volume", "source_name", "ingestion_timestamp"))
    if ticker is None and limit is None:
        return rows  # the whole universe is not sorted
    ordered = rows.orderBy("price_date", "ticker", "source_name")
    return ordered if limit is None else ordered.limit(limit)


def resolve_prices(prices: DataFrame, source_priority: dict[int, int] | None = None) -> DataFrame:
    """One row per (asset, date): the preferred source, then the latest ingest."""
    rank = F.lit(0)
    if source_priority:
        table = F.create_map(*[F.lit(x).cast("long") for kv in source_priority.items() for x in kv])
        rank = -F.coalesce(table[F.col("source_id")], F.lit(1_000_000).cast("long"))
    order = F.struct(rank, "ingestion_timestamp", -F.col("source_id"))
    payload = [c for c in prices.columns if c not in ("asset_id", "price_date")]
    return (prices.groupBy("asset_id", "price_date").agg(F.max_by(F.struct(*payload), order).alias("p"))
            .select("asset_id", "price_date", "p.*"))


def market_feature_source(prices: DataFrame, assets: DataFrame, sources: DataFrame, ticker: str | None = None,
                          start=None, end=None, source_priority: dict[int, int] | None = None,
                          resolve: bool = True) -> DataFrame:
    """Feature input of all assets with the analysis price, one row per (asset, date)."""
    rows = _between(prices, "price_date", start, end)
    if ticker is not None:  # before the aggregation, which then sees one asset only
        rows = rows.join(_only(assets, ticker).select("asset_id"), "asset_id", "left_semi")
    if resolve:
        rows = resolve_prices(rows, source_priority)
    return (rows.join(_only(assets, ticker).select("asset_id", "ticker"), "asset_id")
            .join(sources.select("source_id", "source_name"), "source_id")
            .select("asset_id", "ticker", "price_date", "open_price", "high_price", "low_price", "close_price",
                    "adjusted_close", "volume", "source_name",
                    F.coalesce(F.col("adjusted_close"), F.col("close_price")).cast("double").alias("analysis_price")))


def recent_prices(prices: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` rows per asset."""
    cols = ["price_date", "open_price", "high_price", "low_price", "close_price", "adjusted_close", "volume"]
    return newest_rows(prices, n, ["asset_id"], [F.desc("price_date")]).select("asset_id", *cols)


def recent_prices_of(prices: DataFrame, assets: DataFrame, ticker: str, n: int = 10) -> DataFrame:
    rows = prices.join(_only(assets, ticker).select("asset_id", "ticker"), "asset_id")
    return rows.orderBy(F.desc("price_date"), "source_id").limit(n)


def price_listing(prices: DataFrame, assets: DataFrame, n: int = 25) -> DataFrame:
    return (prices.join(assets.select("asset_id", "ticker", "asset_name", "asset_class"), "asset_id")
            .orderBy("ticker", F.desc("price_date"), "source_id").limit(n)
            .select("ticker", "asset_name", "asset_class", "price_date", "close_price", "volume"))


def latest_ingested(prices: DataFrame, assets: DataFrame, sources: DataFrame, n: int = 15) -> DataFrame:
    return (prices.join(assets.select("asset_id", "ticker"), "asset_id")
            .join(sources.select("source_id", "source_name"), "source_id")
            .orderBy(F.desc("ingestion_timestamp"), "ticker").limit(n)
            .select("ticker", "price_date", "close_price", "ingestion_timestamp", "source_name"))


def joined_sample(prices: DataFrame, assets: DataFrame, sources: DataFrame, n: int = 15) -> DataFrame:
    return (prices.join(assets.select("asset_id", "ticker", "asset_name"), "asset_id")
            .join(sources.select("source_id", "source_name"), "source_id")
            .orderBy(F.desc("price_date"), "ticker", "source_name").limit(n)
            .select("ticker", "asset_name", "source_name", "price_date", "close_price", "adjusted_close", "volume"))


# --- coverage ---------------------------------------------------------------------------------

def _with_ticker(per_asset: DataFrame, assets: DataFrame) -> DataFrame:
    """Aggregate first, then look the ticker up: only one row per asset reaches the join."""
    return per_asset.join(assets.select("asset_id", "ticker"), "asset_id").drop("asset_id")


def price_counts(prices: DataFrame, assets: DataFrame) -> DataFrame:
    return _with_ticker(prices.groupBy("asset_id").agg(F.count("*").alias("price_row_count")), assets).orderBy(
        F.desc("price_row_count"), "ticker")


def price_coverage(prices: DataFrame, assets: DataFrame) -> DataFrame:
    return _with_ticker(prices.groupBy("asset_id").agg(
        F.min("price_date").alias("first_price_date"), F.max("price_date").alias("last_price_date"),
        F.count("*").alias("total_rows")), assets).orderBy("ticker")


def price_profile(prices: DataFrame, assets: DataFrame) -> DataFrame:
    c, v = F.col("close_price"), F.col("volume")
    return _with_ticker(prices.groupBy("asset_id").agg(
        F.min(c).alias("min_close_price"), F.max(c).alias("max_close_price"), F.avg(c).alias("avg_close_price"),
        F.min(v).alias("min_volume"), F.max(v).alias("max_volume"), F.avg(v).alias("avg_volume")), assets).orderBy("ticker")


def source_counts(prices: DataFrame, assets: DataFrame, sources: DataFrame) -> DataFrame:
    per_pair = prices.groupBy("source_id", "asset_id").agg(F.count("*").alias("price_row_count"))
    return (_with_ticker(per_pair, assets).join(sources.select("source_id", "source_name"), "source_id")
            .select("source_name", "ticker", "price_row_count").orderBy("source_name", "ticker"))


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
              for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


# --- news -------------------------------------------------------------------------------------

def recent_news(articles: DataFrame, assets: DataFrame, sources: DataFrame, ticker: str | None = None,
                limit: int = 20, start=None, end=None) -> DataFrame:
    """Newest ``limit`` articles of one asset, or of every asset (cut per asset before the joins)."""
    newest = [F.desc("published_at"), F.asc("url")]
    rows = _between_days(articles, "published_at", start, end)
    if ticker is None:
        rows = newest_rows(rows, limit, ["asset_id"], newest)
    joined = (rows.join(_only(assets, ticker).select("asset_id", "ticker"), "asset_id")
              .join(sources.select("source_id", "source_name"), "source_id"))
    picked = joined if ticker is None else joined.orderBy(*newest).limit(limit)
    return picked.select("ticker", "publisher_name", "headline", "summary", "url", "published_at", "sentiment_score",
                         "sentiment_label", "query_text", "source_name", "ingestion_timestamp")


def sentiment_source(articles: DataFrame | None, assets: DataFrame, sources: DataFrame, ticker: str | None = None,
                     start=None, end=None) -> DataFrame:
    """Article-level sentiment; an empty frame with the same schema when there is no news table."""
    if articles is None:
        return assets.sparkSession.createDataFrame(
            [], "asset_id long, ticker string, published_at timestamp, sentiment_score double, "
                "sentiment_label string, source_name string")
    return (_between_days(articles, "published_at", start, end)
            .join(_only(assets, ticker).select("asset_id", "ticker"), "asset_id")
            .join(sources.select("source_id", "source_name"), "source_id")
            .select("asset_id", "ticker", "published_at", "sentiment_score", "sentiment_label", "source_name"))


def recent_headlines(articles: DataFrame, n: int = 8) -> DataFrame:
    rows = articles.where(F.col("published_at").isNotNull() & F.col("sentiment_score").isNotNull())
    top = newest_rows(rows, n, ["asset_id"], [F.desc("published_at"), F.asc("url")])
    return top.select("asset_id", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published_at"),
                      "publisher_name", "headline", "sentiment_label", "sentiment_score", "source_name", "url")


def sentiment_freshness(articles: DataFrame, as_of, hours: int = 24) -> DataFrame:
    latest = articles.groupBy("asset_id").agg(F.max("ingestion_timestamp").alias("latest_ingestion"))
    limit = F.timestamp_add("HOUR", F.lit(-hours), F.lit(as_of).cast("timestamp"))
    return latest.withColumn("is_fresh", F.coalesce(F.col("latest_ingestion") >= limit, F.lit(False)))


# --- feature store and predictions ------------------------------------------------------------

def training_frame(technical: DataFrame, sentiment: DataFrame, assets: DataFrame, ticker: str | None = None,
                   start=None, end=None) -> DataFrame:
    """Technical features with sentiment of the same asset and day, where there is any."""
    t = _between(technical.drop("ticker"), "feature_date", start, end)
    return (t.join(_only(assets, ticker).select("asset_id", "ticker"), "asset_id")
            .join(sentiment, ["asset_id", "feature_date"], "left")
            .select("asset_id", "ticker", "feature_date", *TECHNICAL_COLUMNS, RETURN_TARGET, NEGATIVE_TARGET,
                    "feature_version", *SENTIMENT_COLUMNS))


# fixed values: columns of a prediction in listings
_PREDICTION_HEAD = ["as_of_date", "prediction_horizon_days", "regression_model_name", "classification_model_name",
                    "predicted_return_20d", "downside_probability_20d", "probability_positive_20d",
                    "predicted_negative_return_flag", "composite_ml_score", "confidence_score", "directional_signal",
                    "history_score", "risk_score", "sentiment_score", "prediction_generated_at"]


def predictions(stored: DataFrame, assets: DataFrame, ticker: str | None = None) -> DataFrame:
    rows = stored.join(_only(assets, ticker).select("asset_id", "ticker"), "asset_id")
    listed = rows.select("ticker", "model_run_id", *_PREDICTION_HEAD)
    return listed if ticker is None else listed.orderBy("ticker", "as_of_date")


# fixed values: same-day features shown with a prediction
SNAPSHOT_TECHNICAL = ["realized_volatility_20d", "recent_realized_volatility_5d", "downside_volatility_20d",
                      "rolling_volatility_20d", "momentum_20d", "ma_distance_20d", "drawdown_from_peak",
                      "volume_ratio_20d"]
SNAPSHOT_SENTIMENT = ["sentiment_mean_1d", "sentiment_mean_7d", "negative_article_share_7d", "article_count_7d",
                      "source_count_7d", "source_sentiment_dispersion_7d"]


def latest_prediction(stored: DataFrame, assets: DataFrame, runs: DataFrame, technical: DataFrame,
                      sentiment: DataFrame, ticker: str | None = None) -> DataFrame:
    """Latest prediction per asset with its run and same-day features.

    The latest row is picked before the joins, so they see one row per asset.
    """
    rows = stored.join(_only(assets, ticker).select("asset_id", "ticker"), "asset_id")
    payload = [c for c in rows.columns if c != "asset_id"]
    latest = (rows.groupBy("asset_id")
              .agg(F.max_by(F.struct(*payload), F.struct("as_of_date", "prediction_generated_at")).alias("p"))
              .select("asset_id", "p.*"))
    run = runs.select(F.col("run_id").alias("model_run_id"), "run_timestamp", "evaluation_summary", "feature_version")
    tech = technical.select("asset_id", F.col("feature_date").alias("as_of_date"), *SNAPSHOT_TECHNICAL)
    sent = sentiment.select("asset_id", F.col("feature_date").alias("as_of_date"), *SNAPSHOT_SENTIMENT)
    return (latest.join(run, "model_run_id", "left").join(tech, ["asset_id", "as_of_date"], "left")
            .join(sent, ["asset_id", "as_of_date"], "left"))


def is_complete(snapshot: DataFrame) -> DataFrame:
    """Flags stored predictions that carry all six required fields."""
    required = ["composite_ml_score", "confidence_score", "history_score", "risk_score", "sentiment_score",
                "directional_signal"]
    return snapshot.withColumn("is_complete", reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required]))


def prediction_history(stored: DataFrame, assets: DataFrame, limit: int = 60, ticker: str | None = None) -> DataFrame:
    rows = newest_rows(stored, limit, ["asset_id"], [F.desc("as_of_date"), F.desc("prediction_generated_at")])
    return rows.join(_only(assets, ticker).select("asset_id", "ticker"), "asset_id").select("ticker", *_PREDICTION_HEAD)


def driver_frame(technical: DataFrame, sentiment: DataFrame, lookback_rows: int = 252) -> DataFrame:
    """Latest joined feature rows per asset."""
    tech = newest_rows(technical.select("asset_id", "feature_date", *SNAPSHOT_TECHNICAL), lookback_rows,
                       ["asset_id"], [F.desc("feature_date")])
    sent = sentiment.select("asset_id", "feature_date", *SNAPSHOT_SENTIMENT[1:])
    return tech.join(sent, ["asset_id", "feature_date"], "left")


# --- validation and freshness -----------------------------------------------------------------

def dataset_validation(requests: DataFrame, assets: DataFrame, prices: DataFrame) -> DataFrame:
    """One status row per requested ticker."""
    wanted = requests.select(ticker_code(F.col("ticker")).alias("requested")).distinct()
    counts = prices.groupBy("asset_id").agg(
        F.count("*").alias("price_rows"),
        F.count(F.coalesce("adjusted_close", "close_price")).alias("clean_prices"))
    known = assets.select("asset_id", "ticker").join(counts, "asset_id", "left")
    j = wanted.join(known, wanted.requested == known.ticker, "left")
    status = (F.when(F.col("requested") == "", "invalid_input")
              .when(F.col("ticker").isNull(), "missing_metadata")
              .when(ticker_code(F.col("ticker")) != F.col("requested"), "asset_identity_mismatch")
              .when(F.coalesce("price_rows", F.lit(0)) == 0, "missing_price_history")
              .when(F.col("clean_prices") < 2, "insufficient_price_history")
              .otherwise("validated"))
    return j.select(F.col("requested").alias("ticker"), status.alias("status"),
                    F.coalesce("price_rows", F.lit(0)).alias("price_rows"),
                    F.coalesce("clean_prices", F.lit(0)).alias("clean_prices"),
                    (status == "validated").alias("success"))


def market_freshness(assets: DataFrame, prices: DataFrame, state: DataFrame, as_of, metadata_hours: int = 24,
                     price_hours: int = 6, provider: str | None = None) -> DataFrame:
    """Freshness flags and cache hits; rows without a hit are the fetch list."""
    if provider is not None:
        state = state.where(F.col("provider_name") == provider)
    moment = F.lit(as_of).cast("timestamp")
    counts = prices.groupBy("asset_id").agg(F.count("*").alias("price_rows"))
    fetched = state.groupBy("ticker").agg(F.max("metadata_fetched_at").alias("metadata_fetched_at"),
                                          F.max("prices_fetched_at").alias("prices_fetched_at"),
                                          F.max("last_successful_fetch_at").alias("last_successful_fetch_at"))
    j = assets.select("asset_id", "ticker").join(counts, "asset_id", "left").join(fetched, "ticker", "left")

    def fresh(c, hours):
        return F.coalesce(F.col(c) >= F.timestamp_add("HOUR", F.lit(-hours), moment), F.lit(False))
    return j.select(
        "ticker", F.coalesce("price_rows", F.lit(0)).alias("price_rows"),
        fresh("metadata_fetched_at", metadata_hours).alias("metadata_fresh"),
        fresh("prices_fetched_at", price_hours).alias("price_fresh"), "last_successful_fetch_at",
    ).withColumn("is_cache_hit", (F.col("price_rows") > 0) & F.col("metadata_fresh") & F.col("price_fresh"))


# fixed values: columns never used as model features
NOT_FEATURES = {"asset_id", "ticker", "feature_date", "price_date", "feature_version", RETURN_TARGET, NEGATIVE_TARGET}
_NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint", "decimal")


def feature_columns(frame: DataFrame) -> list[str]:
    """Numeric columns that are not keys, tags or targets."""
    return [n for n, t in frame.dtypes if n not in NOT_FEATURES and t.startswith(_NUMERIC)]
