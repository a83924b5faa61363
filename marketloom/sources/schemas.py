"""Declared schemas of the stored tables, with their natural keys."""

from __future__ import annotations

from pyspark.sql import types as T

_PRICE = T.DecimalType(18, 6)


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


DATA_SOURCES = _struct(
    ("source_id", T.LongType(), False),
    ("source_name", T.StringType(), False),
    ("source_type", T.StringType(), False),
    ("source_url", T.StringType(), True),
    ("created_at", T.TimestampType(), True),
    ("updated_at", T.TimestampType(), True),
)

ASSETS = _struct(
    ("asset_id", T.LongType(), False),
    ("ticker", T.StringType(), False),
    ("asset_name", T.StringType(), False),
    ("asset_class", T.StringType(), True),
    ("exchange", T.StringType(), True),
    ("currency", T.StringType(), False),
    ("sector", T.StringType(), True),
    ("industry", T.StringType(), True),
    ("country", T.StringType(), True),
    ("is_active", T.BooleanType(), False),
    ("primary_source_id", T.LongType(), True),
    ("created_at", T.TimestampType(), True),
    ("updated_at", T.TimestampType(), True),
)

HISTORICAL_PRICES = _struct(
    ("asset_id", T.LongType(), False),
    ("source_id", T.LongType(), False),
    ("price_date", T.DateType(), False),
    ("open_price", _PRICE, True),
    ("high_price", _PRICE, True),
    ("low_price", _PRICE, True),
    ("close_price", _PRICE, False),
    ("adjusted_close", _PRICE, True),
    ("volume", T.LongType(), True),
    ("ingestion_timestamp", T.TimestampType(), False),
    ("created_at", T.TimestampType(), True),
)

INGESTION_STATE = _struct(
    ("ticker", T.StringType(), False),
    ("provider_name", T.StringType(), False),
    ("asset_type", T.StringType(), True),
    ("request_timestamp", T.TimestampType(), True),
    ("last_successful_fetch_at", T.TimestampType(), True),
    ("fetch_status", T.StringType(), False),
    ("error_message", T.StringType(), True),
    ("record_count_fetched", T.LongType(), True),
    ("coverage_start_date", T.DateType(), True),
    ("coverage_end_date", T.DateType(), True),
    ("metadata_fetched_at", T.TimestampType(), True),
    ("prices_fetched_at", T.TimestampType(), True),
    ("created_at", T.TimestampType(), True),
    ("updated_at", T.TimestampType(), True),
)

INGESTION_RUN_LOGS = _struct(
    ("ticker", T.StringType(), False),
    ("provider_name", T.StringType(), False),
    ("asset_type", T.StringType(), True),
    ("started_at", T.TimestampType(), False),
    ("completed_at", T.TimestampType(), True),
    ("fetch_status", T.StringType(), False),
    ("error_message", T.StringType(), True),
    ("cache_status", T.StringType(), True),
    ("record_count_fetched", T.LongType(), True),
    ("records_written", T.LongType(), True),
    ("coverage_start_date", T.DateType(), True),
    ("coverage_end_date", T.DateType(), True),
)

# Rows that an ingest batch turned away, as they came, with the reason.
REJECTED_ROWS = _struct(
    ("table_name", T.StringType(), False),
    ("provider_name", T.StringType(), False),
    ("ticker", T.StringType(), True),
    ("reason", T.StringType(), False),
    ("row_json", T.StringType(), True),
    ("rejected_at", T.TimestampType(), False),
)

NEWS_ARTICLES = _struct(
    ("asset_id", T.LongType(), False),
    ("source_id", T.LongType(), False),
    ("provider_article_id", T.StringType(), True),
    ("publisher_name", T.StringType(), True),
    ("headline", T.StringType(), False),
    ("summary", T.StringType(), True),
    ("url", T.StringType(), False),
    ("published_at", T.TimestampType(), False),
    ("sentiment_score", T.DoubleType(), False),
    ("sentiment_label", T.StringType(), False),
    ("query_text", T.StringType(), True),
    ("ingestion_timestamp", T.TimestampType(), False),
    ("created_at", T.TimestampType(), True),
)

# fixed values: stored feature columns, in storage order
TECHNICAL_COLUMNS = [
    "analysis_price", "close_price", "adjusted_close", "volume",
    "daily_return", "return_lag_1d", "return_lag_5d", "return_lag_10d",
    "rolling_mean_return_5d", "rolling_mean_return_20d",
    "rolling_volatility_10d", "rolling_volatility_20d",
    "realized_volatility_20d", "recent_realized_volatility_5d",
    "momentum_5d", "momentum_10d", "momentum_20d",
    "ma_distance_10d", "ma_distance_20d",
    "drawdown_from_peak", "rolling_drawdown_20d", "downside_volatility_20d",
    "intraday_range_pct", "volume_change_1d", "volume_ratio_20d", "volume_zscore_20d",
]
SENTIMENT_COLUMNS = [
    "article_count_1d", "sentiment_mean_1d", "sentiment_mean_7d", "sentiment_std_7d",
    "negative_article_share_7d", "positive_article_share_7d",
    "article_count_7d", "source_count_7d", "source_sentiment_dispersion_7d",
]
RETURN_TARGET = "target_forward_return_20d"
NEGATIVE_TARGET = "target_negative_return_20d"
FEATURE_VERSION = "v1"
TRADING_DAYS = 252

_COUNTS = {"volume", "article_count_1d", "article_count_7d", "source_count_7d"}


def _feature_fields(names: list[str]) -> list[tuple[str, T.DataType, bool]]:
    return [(n, T.LongType() if n in _COUNTS else T.DoubleType(), True) for n in names]


TECHNICAL_FEATURES = _struct(
    ("asset_id", T.LongType(), False),
    ("feature_date", T.DateType(), False),
    *_feature_fields(TECHNICAL_COLUMNS),
    (RETURN_TARGET, T.DoubleType(), True),
    (NEGATIVE_TARGET, T.IntegerType(), True),
    ("feature_version", T.StringType(), False),
)

SENTIMENT_FEATURES = _struct(
    ("asset_id", T.LongType(), False),
    ("feature_date", T.DateType(), False),
    *_feature_fields(SENTIMENT_COLUMNS),
)

ML_MODEL_RUNS = _struct(
    ("run_id", T.StringType(), False),
    ("run_timestamp", T.TimestampType(), False),
    ("regression_model_name", T.StringType(), False),
    ("classification_model_name", T.StringType(), False),
    ("training_start_date", T.DateType(), True),
    ("training_end_date", T.DateType(), True),
    ("evaluation_summary", T.StringType(), True),
    ("feature_version", T.StringType(), False),
    ("notes", T.StringType(), True),
)

ML_PREDICTIONS = _struct(
    ("asset_id", T.LongType(), False),
    ("as_of_date", T.DateType(), False),
    ("prediction_horizon_days", T.IntegerType(), False),
    ("model_run_id", T.StringType(), True),
    ("regression_model_name", T.StringType(), False),
    ("classification_model_name", T.StringType(), False),
    ("selected_model_name", T.StringType(), True),
    ("model_family", T.StringType(), True),
    ("target_name", T.StringType(), True),
    *[(n, T.DoubleType(), True) for n in (
        "predicted_return_20d", "downside_probability_20d", "probability_positive_20d")],
    ("predicted_negative_return_flag", T.IntegerType(), False),
    ("composite_ml_score", T.DoubleType(), True),
    ("confidence_score", T.DoubleType(), True),
    ("directional_signal", T.StringType(), True),
    *[(n, T.DoubleType(), True) for n in (
        "history_score", "risk_score", "sentiment_score",
        "history_contribution", "risk_contribution", "sentiment_contribution")],
    ("pillar_weights_json", T.StringType(), True),
    ("feature_importance_json", T.StringType(), True),
    ("top_features_json", T.StringType(), True),
    ("prediction_generated_at", T.TimestampType(), False),
)

TABLES = {
    "data_sources": (DATA_SOURCES, ["source_name"]),
    "assets": (ASSETS, ["ticker"]),
    "historical_prices": (HISTORICAL_PRICES, ["asset_id", "source_id", "price_date"]),
    "market_data_ingestion_state": (INGESTION_STATE, ["ticker", "provider_name"]),
    "ingestion_run_logs": (INGESTION_RUN_LOGS, []),
    "rejected_rows": (REJECTED_ROWS, []),
    "news_articles": (NEWS_ARTICLES, ["asset_id", "source_id", "url"]),
    "technical_features": (TECHNICAL_FEATURES, ["asset_id", "feature_date"]),
    "sentiment_features": (SENTIMENT_FEATURES, ["asset_id", "feature_date"]),
    "ml_model_runs": (ML_MODEL_RUNS, ["run_id"]),
    "ml_predictions": (ML_PREDICTIONS, [
        "asset_id", "as_of_date", "prediction_horizon_days",
        "regression_model_name", "classification_model_name"]),
}


def scan(spark, table: str, path: str):
    """Typed scan: the schema is declared, never inferred."""
    return spark.read.schema(TABLES[table][0]).parquet(path)
