"""Normalization of raw provider rows: daily bars, asset metadata and news feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.columns import (
    blank_to_null, fallback_article_id, finite, lexical_score, published_time, sentiment_label)


def parse_bars(raw: DataFrame) -> DataFrame:
    """Zone-stripped date, six-decimal prices, whole volume; what cannot be read is NULL, every row stays.

    ``raw``: keys, ``date`` text, ``open high low close adj_close volume`` doubles.
    """
    def price(c):
        return F.bround(finite(F.col(c).cast("double")), 6).try_cast("decimal(18,6)")
    keys = [c for c in raw.columns if c not in ("date", "open", "high", "low", "close", "adj_close", "volume")]
    return raw.select(
        *keys,
        # the local calendar day is kept, the zone is dropped
        F.substring(F.col("date").cast("string"), 1, 10).try_cast("date").alias("price_date"),
        price("open").alias("open_price"), price("high").alias("high_price"), price("low").alias("low_price"),
        price("close").alias("close_price"), price("adj_close").alias("adjusted_close"),
        finite(F.col("volume").cast("double")).try_cast("long").alias("volume"),
    )


def normalize_bars(raw: DataFrame) -> DataFrame:
    """``parse_bars`` without the rows that have no close."""
    return parse_bars(raw).dropna(subset=["close_price"])


def normalize_metadata(raw: DataFrame) -> DataFrame:
    """Asset metadata from a raw provider table; the first non-empty spelling of a field wins."""
    def first_of(*names):
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in raw.columns])
    return raw.select(
        F.upper(F.trim("ticker")).alias("ticker"),
        F.coalesce(first_of("short_name", "long_name", "instrument_type"), F.upper(F.trim("ticker"))).alias("asset_name"),
        blank_to_null(first_of("quote_type", "instrument_type")).alias("asset_class"),
        blank_to_null(first_of("exchange", "fast_exchange")).alias("exchange"),
        F.upper(F.coalesce(first_of("currency", "fast_currency"), F.lit("USD"))).alias("currency"),
        *[blank_to_null(F.nullif(F.col(c), F.lit(""))).alias(c) for c in ("sector", "industry", "country")],
        (~F.coalesce(F.col("data_delayed_by") == -1, F.lit(False))).alias("is_active"),
    )


_SOURCE = T.StructType([T.StructField("name", T.StringType()), T.StructField("url", T.StringType())])

# One schema per feed shape; numbers arrive as text so that ids and epochs survive unchanged.
_FLAT = T.StructType([T.StructField(n, T.StringType()) for n in (
    "id", "headline", "title", "summary", "description", "snippet", "content", "url", "datetime",
    "publishedAt", "source")])
_NESTED = T.StructType([f for f in _FLAT.fields if f.name != "source"] + [T.StructField("source", _SOURCE)])

# fixed values: which fields each feed shape offers, in order of preference
FEED_SHAPES = {
    "flat": {"headline": ["headline", "title"], "summary": ["summary", "description", "snippet"],
             "time": ["datetime", "publishedAt"], "id": ["id"]},
    "nested": {"headline": ["title"], "summary": ["description", "content"],
               "time": ["publishedAt"], "id": ["id"]},
    "nested_without_id": {"headline": ["title"], "summary": ["description"], "time": ["publishedAt"], "id": []},
}


def _text(c):
    return F.nullif(F.trim(c), F.lit(""))


def normalize_feed(raw: DataFrame, shape: str, payload: str = "payload", keep_unusable: bool = False, **lexicon) -> DataFrame:
    """One feed shape to the article schema; rows without headline, url or time are dropped, or kept if asked."""
    fields = FEED_SHAPES[shape]
    schema = _FLAT if shape == "flat" else _NESTED
    keys = [c for c in raw.columns if c != payload]
    j = raw.select(*keys, F.from_json(payload, schema).alias("j"))

    def pick(names):
        options = [_text(F.col(f"j.{n}")) for n in names]
        return F.coalesce(*options) if options else F.lit(None).cast("string")
    publisher = F.col("j.source") if shape == "flat" else F.col("j.source.name")
    parsed = j.select(
        *keys, pick(fields["headline"]).alias("headline"), pick(fields["summary"]).alias("summary"),
        _text(F.col("j.url")).alias("url"), published_time(pick(fields["time"])).alias("published_at"),
        _text(publisher).alias("publisher_name"), pick(fields["id"]).alias("raw_id"))
    usable = parsed if keep_unusable else parsed.where(
        F.col("headline").isNotNull() & F.col("url").isNotNull() & F.col("published_at").isNotNull())
    scored = usable.withColumn("sentiment_score", lexical_score(F.concat_ws(" ", "headline", "summary"), **lexicon))
    return scored.select(
        *keys, "headline", "summary", "url", "published_at", "publisher_name",
        F.coalesce("raw_id", fallback_article_id(F.col("url"), F.col("headline"), F.col("published_at")))
        .alias("provider_article_id"),
        "sentiment_score", sentiment_label(F.col("sentiment_score")).alias("sentiment_label"))


def normalize_feeds(raw: DataFrame, shape_column: str = "shape", payload: str = "payload", keep_unusable: bool = False, **lexicon) -> DataFrame:
    """A table holding all feed shapes: each is normalized on its own, the results are unioned by name."""
    parts = [normalize_feed(raw.where(F.col(shape_column) == s), s, payload, keep_unusable, **lexicon) for s in FEED_SHAPES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
