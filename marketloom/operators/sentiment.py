"""Daily and trailing news-sentiment features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.columns import lexical_score, ratio, sentiment_label
from marketloom.operators.windows import full_window, last_rows
from marketloom.sources.schemas import SENTIMENT_COLUMNS


def exact_sum(column: str):
    """Sum on decimals: the same result however the rows are spread over tasks."""
    return F.sum(F.col(column).cast("decimal(18,10)")).cast("double")


def source_daily_sentiment(articles: DataFrame) -> DataFrame:
    """Sums per (asset, day, source): the one pass over raw articles, pre-aggregated before its shuffle."""
    label = F.lower("sentiment_label")
    usable = articles.where(F.col("published_at").isNotNull() & F.col("sentiment_score").isNotNull())
    return usable.groupBy(
        "asset_id", F.to_date("published_at").alias("feature_date"),
        F.coalesce("source_name", F.lit("unknown_source")).alias("source_name"),
    ).agg(
        F.count("*").alias("articles"),
        exact_sum("sentiment_score").alias("score_sum"),
        F.count_if(label == "negative").alias("negatives"),
        F.count_if(label == "positive").alias("positives"),
    )


def daily_sentiment(articles: DataFrame) -> DataFrame:
    """Article count, mean score, label shares, distinct sources and source dispersion per asset and day.

    Distinct sources and the dispersion both follow from the per-source rows, so the raw articles
    are shuffled once and no distinct aggregation is needed.
    """
    per_source = source_daily_sentiment(articles)
    total = F.sum("articles")
    return per_source.groupBy("asset_id", "feature_date").agg(
        total.alias("article_count_1d"),
        ratio(exact_sum("score_sum"), total).alias("sentiment_mean_1d"),
        ratio(F.sum("negatives").cast("double"), total).alias("negative_article_share_1d"),
        ratio(F.sum("positives").cast("double"), total).alias("positive_article_share_1d"),
        F.count("*").alias("source_count_1d"),
        F.stddev_samp(ratio(F.col("score_sum"), F.col("articles"))).alias("source_sentiment_dispersion_1d"),
    )


def sentiment_features(articles: DataFrame, days: int = 7) -> DataFrame:
    """Trailing features over the last ``days`` days that had articles (rows, not calendar days)."""
    w = last_rows(days, "feature_date")
    mean = F.col("sentiment_mean_1d")
    trailing = {
        "sentiment_mean_7d": F.avg(mean).over(w),
        "sentiment_std_7d": full_window(F.stddev_samp(mean), mean, days, w, least=2),
        "negative_article_share_7d": F.avg("negative_article_share_1d").over(w),
        "positive_article_share_7d": F.avg("positive_article_share_1d").over(w),
        "article_count_7d": F.sum("article_count_1d").over(w),
        "source_count_7d": F.max("source_count_1d").over(w),
        "source_sentiment_dispersion_7d": F.avg("source_sentiment_dispersion_1d").over(w),
    }
    return daily_sentiment(articles).select(
        "asset_id", "feature_date",
        *[trailing[c].alias(c) if c in trailing else F.col(c) for c in SENTIMENT_COLUMNS])


def score_texts(documents: DataFrame, text: str = "text", **lexicon) -> DataFrame:
    scored = documents.withColumn("sentiment_score", lexical_score(F.col(text), **lexicon))
    return scored.withColumn("sentiment_label", sentiment_label(F.col("sentiment_score")))


def sentiment_summary(articles: DataFrame) -> DataFrame:
    usable = articles.where(F.col("published_at").isNotNull() & F.col("sentiment_score").isNotNull())
    label = F.col("sentiment_label")
    return usable.groupBy("asset_id").agg(
        F.count("*").alias("article_count"),
        ratio(exact_sum("sentiment_score"), F.count("*")).alias("average_sentiment"),
        *[F.count_if(label == n).alias(f"{n}_count") for n in ("positive", "negative", "neutral")],
        F.max("published_at").alias("latest_published_at"),
    )


def sentiment_trend(articles: DataFrame) -> DataFrame:
    usable = articles.where(F.col("published_at").isNotNull() & F.col("sentiment_score").isNotNull())
    return usable.groupBy("asset_id", F.to_date("published_at").alias("published_date")).agg(
        F.bround(F.avg(F.col("sentiment_score").cast("decimal(18,10)")), 4).cast("double").alias("average_sentiment"),
        F.count("headline").alias("article_count"),
    )
