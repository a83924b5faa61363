"""Feature store: technical features with targets, sentiment features, and their join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.sentiment import sentiment_features
from marketloom.operators.technical import technical_features
from marketloom.sources.lake import LakeTable
from marketloom.sources.schemas import SENTIMENT_COLUMNS


def feature_store_frames(bars: DataFrame, articles: DataFrame | None = None, horizon_days: int = 20) -> dict[str, DataFrame]:
    """Technical features, sentiment features and the training frame of the whole universe.

    ``bars``: one row per (asset, date) with ticker and analysis price. Targets come out of the same
    window pass as the features, so no join is needed for them.
    """
    technical = technical_features(bars, keep_targets_for=horizon_days)
    if articles is None:
        sentiment = technical.select("asset_id", "feature_date", *[
            F.lit(None).cast("double").alias(c) for c in SENTIMENT_COLUMNS]).where(F.lit(False))
    else:
        sentiment = sentiment_features(articles)
    return {
        "technical_features": technical,
        "sentiment_features": sentiment,
        "training_frame": technical.join(sentiment, ["asset_id", "feature_date"], "left"),
    }


def refresh_feature_store(spark, root: str, bars: DataFrame, articles: DataFrame | None, batch_id: int,
                          horizon_days: int = 20) -> dict[str, DataFrame]:
    """Upsert both feature tables and return them as stored."""
    frames = feature_store_frames(bars, articles, horizon_days)
    stored = {}
    for name in ("technical_features", "sentiment_features"):
        table = LakeTable(spark, root, name)
        table.write_batch(frames[name], batch_id)
        stored[name] = table.current()
    return stored
