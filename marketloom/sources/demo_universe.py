"""Asset-universe views over the generated benchmark tables.

Suppliers play the assets, line items the ticks behind daily bars, events the scored news and
documents the unscored news text. Every view is lazy and grows with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import lexical_score, sentiment_label

# fixed values: the feeds of the demo universe
FEEDS = [
    (1, "feed_f", "market_data"), (2, "feed_o", "market_data"),
    (3, "click", "news_api"), (4, "error", "news_api"), (5, "purchase", "news_api"),
    (6, "signup", "news_api"), (7, "view", "news_api"),
]
EVENT_SHIFT_DAYS = 8219
DEMO_POSITIVE, DEMO_NEGATIVE = ["the", "of", "and"], ["a", "in", "to"]


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def data_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(FEEDS, "source_id long, source_name string, source_type string").withColumn(
        "source_url", F.concat(F.lit("https://feeds.test/"), "source_name"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read(spark, sf_dir, "supplier")
    nation = read(spark, sf_dir, "nation")
    key = F.col("s_suppkey")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        key.alias("asset_id"),
        F.when(key == 0, "SPY").otherwise(F.concat(F.lit("S"), F.lpad(key.cast("string"), 6, "0"))).alias("ticker"),
        F.col("s_name").alias("asset_name"),
        F.when(key % 5 == 0, "ETF").otherwise("Equity").alias("asset_class"),
        F.concat(F.lit("X"), F.col("n_regionkey").cast("string")).alias("exchange"),
        F.lit("USD").alias("currency"),
        F.when(key % 4 != 0, F.concat(F.lit("sector "), (key % 11).cast("string"))).alias("sector"),
        F.lit(None).cast("string").alias("industry"),
        F.col("n_name").alias("country"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
        F.when(key % 10 != 9, key % 2 + 1).alias("primary_source_id"),
    )


def _bar_columns():
    # sums in whole cents: exact in any order, and cheaper than decimals
    amount = F.sum(F.rint(F.col("l_extendedprice") * 100).cast("long")) / F.lit(100.0)
    quantity = F.sum(F.rint(F.col("l_quantity") * 100).cast("long")) / F.lit(100.0)
    unit = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    return [
        F.max(unit).alias("high_price"),
        F.min(unit).alias("low_price"),
        F.try_divide(amount, quantity).alias("close_price"),
        quantity.cast("long").alias("volume"),
    ]


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("asset_id"), F.to_date("l_shipdate").alias("price_date"),
        "l_extendedprice", "l_quantity", "l_linestatus")


def _finish_bars(bars: DataFrame, series: list[str]) -> DataFrame:
    w = Window.partitionBy(*series).orderBy("price_date")
    return (bars
            .withColumn("open_price", F.lag("close_price").over(w))
            .withColumn("adjusted_close",
                        F.when(F.dayofmonth("price_date") % 7 != 0, F.col("close_price"))))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per (asset, date). Ticks are dealt by asset once, and bars and all windows over them need no further shuffle. All ticks of an asset meet in
    one task, where they stream through sums of as many rows as it has dates: a hot asset takes that task time, not memory."""
    ticks = _ticks(spark, sf_dir).drop("l_linestatus").repartition("asset_id")
    daily = ticks.groupBy("asset_id", "price_date").agg(*_bar_columns())
    return _finish_bars(daily, ["asset_id"]).withColumn(
        "analysis_price", F.coalesce("adjusted_close", "close_price"))


def priced_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the ticker of their asset."""
    return bars(spark, sf_dir).join(assets(spark, sf_dir).select("asset_id", "ticker"), "asset_id")


def historical_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per (asset, source, date): two vendors quote most days."""
    daily = (_ticks(spark, sf_dir)
             .withColumn("source_id", F.when(F.col("l_linestatus") == "F", 1).otherwise(2).cast("long"))
             .groupBy("asset_id", "source_id", "price_date").agg(*_bar_columns()))
    stamp = F.timestamp_add("HOUR", F.lit(18) + F.col("source_id").cast("int"), F.col("price_date").cast("timestamp"))
    return _finish_bars(daily, ["asset_id", "source_id"]).withColumn("ingestion_timestamp", stamp)


def news_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored articles; some belong to assets that do not exist."""
    events = read(spark, sf_dir, "events")
    ids = F.create_map(*[x for i, n, kind in FEEDS if kind == "news_api" for x in (F.lit(n), F.lit(i).cast("long"))])
    published = F.timestamp_add("DAY", F.lit(-EVENT_SHIFT_DAYS), F.col("ts").cast("timestamp"))
    raw = (F.col("value").cast("decimal(10,2)") - 35).cast("double") / 100.0
    score = F.greatest(F.least(raw, F.lit(1.0)), F.lit(-1.0))
    return events.select(
        F.col("user_id").alias("asset_id"),
        ids[F.col("event_type")].alias("source_id"),
        F.col("event_id").cast("string").alias("provider_article_id"),
        F.concat(F.lit("desk "), F.col("event_type")).alias("publisher_name"),
        F.concat(F.lit("Item "), F.col("event_id").cast("string")).alias("headline"),
        F.col("props").alias("summary"),
        F.concat(F.lit("https://news.test/"), F.col("event_id").cast("string")).alias("url"),
        published.alias("published_at"),
        score.alias("sentiment_score"),
        sentiment_label(score).alias("sentiment_label"),
        F.lit(None).cast("string").alias("query_text"),
        F.timestamp_add("HOUR", F.lit(1), published).alias("ingestion_timestamp"),
    )


def text_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unscored documents as articles: dated, attached to an asset and scored over their whole text."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    n_assets = read(spark, sf_dir, "supplier", "s_suppkey").agg(F.count("*")).scalar()
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") * 7919 % 2400).cast("int"))
    score = lexical_score(F.col("text"), DEMO_POSITIVE, DEMO_NEGATIVE)
    return docs.select(
        "doc_id", (F.col("doc_id") % n_assets).alias("asset_id"), F.col("source").alias("source_name"),
        day.cast("timestamp").alias("published_at"), F.substring_index("text", "\n", 1).alias("headline"),
        score.alias("sentiment_score"),
    ).withColumn("sentiment_label", sentiment_label(F.col("sentiment_score")))


def ingestion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an ingestion run log: customers request tickers, the order status is the outcome."""
    o = read(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("S"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("ticker"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2", "3"), "feed_f").otherwise("feed_o").alias("provider_name"),
        F.when(F.col("o_custkey") % 5 == 0, "ETF").otherwise("Equity").alias("asset_type"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.when(status == "F", "success").when(status == "P", "timeout").otherwise("provider_error").alias("fetch_status"),
        F.when(status != "F", F.concat(F.lit("status "), status)).alias("error_message"),
        F.floor("o_totalprice").alias("record_count_fetched"),
        F.floor(F.col("o_totalprice") / 2).alias("records_written"),
        F.date_sub(day, 365).alias("coverage_start_date"), day.alias("coverage_end_date"),
    )


def raw_daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw vendor rows: zoned text dates, missing and NaN closes."""
    price = F.col("l_extendedprice")
    net = price * (1 - F.col("l_discount"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("asset_id"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T23:30:00-05:00")).alias("date"),
        price.alias("open"), (price + 1).alias("high"), (price - 1).alias("low"),
        F.when(F.col("l_returnflag") == "R", F.lit(float("nan"))).otherwise(net).alias("close"),
        F.when(F.col("l_linestatus") == "F", net).alias("adj_close"), F.col("l_quantity").alias("volume"))


def with_ticker(rows: DataFrame) -> DataFrame:
    """Raw rows as a vendor sends them: by ticker, spelled carelessly, without an asset id."""
    key = F.col("asset_id")
    code = F.when(key == 0, "spy").otherwise(F.concat(F.lit(" s"), F.lpad(key.cast("string"), 6, "0")))
    return rows.withColumn("ticker", code).drop("asset_id")


def raw_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as raw asset records with blank, missing and spelled-out missing values."""
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit(" s"), F.lpad(key.cast("string"), 6, "0"), F.lit(" ")).alias("ticker"),
        F.when(key % 3 != 0, F.col("c_name")).otherwise("").alias("short_name"),
        F.when(key % 2 != 0, F.concat(F.lit("Long "), "c_name")).alias("long_name"),
        F.lower("c_mktsegment").alias("instrument_type"),
        F.when(key % 4 == 0, "None").when(key % 4 == 1, F.col("c_mktsegment")).alias("quote_type"),
        F.when(key % 5 == 0, "nan").when(key % 5 == 1, " NYS ").otherwise("").alias("exchange"),
        F.lit("ARC").alias("fast_exchange"),
        F.when(key % 6 == 0, "eur").otherwise("").alias("currency"),
        F.when(key % 7 == 0, "gbp").alias("fast_currency"),
        F.when(key % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("sector"),
        F.lit("None").alias("industry"),
        F.concat(F.lit(" C"), F.col("c_nationkey").cast("string")).alias("country"),
        F.when(F.col("c_acctbal") < 0, -1).otherwise(15).alias("data_delayed_by"))


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON payloads of the three feed shapes, some of them unusable."""
    e = read(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    seconds = F.unix_seconds(F.date_trunc("SECOND", F.col("ts").cast("timestamp")))
    iso = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    title = F.concat(F.lit(" beats "), F.col("event_type"), F.lit(" weak growth ")) 
    url = F.when(F.col("event_type") != "error", F.concat(F.lit("https://raw.test/"), n))
    source = F.struct(F.concat(F.lit("pub "), "event_type").alias("name"), F.lit("https://p.test").alias("url"))
    flat = F.to_json(F.struct(
        F.col("event_id").alias("id"), title.alias("headline"), F.lit("record losses").alias("summary"), url.alias("url"),
        F.when(F.col("value") > 20, seconds * 1000).otherwise(seconds).alias("datetime"), F.lit("desk").alias("source")))
    nested = F.to_json(F.struct(
        F.concat(F.lit("n"), n).alias("id"), title.alias("title"), F.lit("").alias("description"),
        F.lit("surge; strong, gains!").alias("content"), url.alias("url"), iso.alias("publishedAt"), source.alias("source")))
    bare = F.to_json(F.struct(title.alias("title"), F.col("props").alias("description"), url.alias("url"),
                              iso.alias("publishedAt"), source.alias("source")))
    shape = (F.when(F.col("event_type").isin("click", "error"), "flat")
             .when(F.col("event_type") == "view", "nested").otherwise("nested_without_id"))
    return e.select("event_id", F.col("user_id").alias("asset_id"), shape.alias("shape"),
                    F.when(shape == "flat", flat).when(shape == "nested", nested).otherwise(bare).alias("payload"))


def price_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-quoted bars from returned lines: some replace a stored bar, the batch arrives a day later."""
    ticks = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    daily = ticks.groupBy(
        F.col("l_suppkey").alias("asset_id"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).cast("long").alias("source_id"),
        F.to_date("l_shipdate").alias("price_date")).agg(*_bar_columns())
    stamp = F.timestamp_add("HOUR", F.lit(42) + F.col("source_id").cast("int"), F.col("price_date").cast("timestamp"))
    return daily.select("*", F.lit(None).cast("double").alias("open_price"), F.col("close_price").alias("adjusted_close"),
                        stamp.alias("ingestion_timestamp"))


def news_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second news batch: same id with a new url, same url without an id, or an entirely new article."""
    kind = F.col("publisher_name")
    moved = F.concat("url", F.lit("/v2"))
    return news_articles(spark, sf_dir).withColumns({
        "provider_article_id": F.when(kind == "desk view", F.lit(None)).when(
            kind == "desk click", F.concat(F.lit("new-"), "provider_article_id")).otherwise(F.col("provider_article_id")),
        "url": F.when(kind.isin("desk signup", "desk click"), moved).otherwise(F.col("url")),
        "headline": F.concat(F.lit(" Update "), "headline", F.lit(" ")),
        "ingestion_timestamp": F.timestamp_add("HOUR", F.lit(5), F.col("published_at")),
    })


def stored_predictions(model_rows: DataFrame) -> DataFrame:
    """A prediction per asset and date, made from features alone, in the stored form."""
    from marketloom.plans.score import MODEL_FAMILY, TARGET_NAME, signal_columns

    raw = model_rows.where(F.col("momentum_20d").isNotNull()).withColumns({
        "raw_return": F.least(F.greatest(F.col("momentum_20d"), F.lit(-0.6)), F.lit(0.6)),
        "raw_challenger": F.col("trailing_return_60d"),
        "raw_probability": 1.0 / (1.0 + F.exp(-3.0 * F.col("momentum_5d")))})
    signal = signal_columns(raw, F.lit(0.25))
    return signal.select(
        "asset_id", F.col("feature_date").alias("as_of_date"), F.lit(20).alias("prediction_horizon_days"),
        F.concat(F.lit("run-"), F.year("feature_date").cast("string")).alias("model_run_id"),
        F.lit("ridge_regression").alias("regression_model_name"),
        F.lit("random_forest_classifier").alias("classification_model_name"),
        F.lit("ridge_regression").alias("selected_model_name"), F.lit(MODEL_FAMILY).alias("model_family"),
        F.lit(TARGET_NAME).alias("target_name"),
        "predicted_return_20d", "downside_probability_20d", "probability_positive_20d",
        "predicted_negative_return_flag", "composite_ml_score", "confidence_score", "directional_signal",
        "history_score", "risk_score", "sentiment_score",
        *[(0.1 * F.col(f"{p}_score")).alias(f"{p}_contribution") for p in ("history", "risk", "sentiment")],
        F.timestamp_add("DAY", F.lit(1), F.col("feature_date").cast("timestamp")).alias("prediction_generated_at"))


def with_gaps(stored: DataFrame, assets: DataFrame) -> DataFrame:
    """Predictions of active assets alone, some of them incomplete: parts are missing on some days of the month."""
    day = F.dayofmonth("as_of_date")

    def unless(missing, *columns):
        return {c: F.when(~missing, F.col(c)) for c in columns}
    return stored.join(assets.where("is_active").select("asset_id"), "asset_id", "left_semi").withColumns({
        **unless(day % 3 == 0, "sentiment_score"), **unless(day % 4 == 1, "composite_ml_score", "directional_signal"),
        **unless(day % 5 == 2, "confidence_score"), **unless(day % 11 == 7, "predicted_return_20d")})


def with_explanations(stored: DataFrame) -> DataFrame:
    """Predictions with their pillars' contributions as a JSON list, unreadable or missing on some days of the month."""
    day = F.dayofmonth("as_of_date")
    pairs = F.array(*[F.struct(F.lit(p).alias("feature"), F.col(f"{p}_contribution").alias("contribution"),
                               F.abs(F.col(f"{p}_contribution")).alias("absolute_contribution")) for p in ("history", "risk", "sentiment")])
    return stored.withColumn("top_features_json", F.when(day % 7 == 3, "[{not json").when(day % 7 != 4, F.to_json(pairs)))


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = read(spark, sf_dir, "lineitem", "l_shipdate").select(F.year("l_shipdate").alias("y")).distinct()
    y = F.col("y").cast("string")
    return years.select(
        F.concat(F.lit("run-"), y).alias("run_id"), F.make_date("y", F.lit(12), F.lit(31)).cast("timestamp").alias("run_timestamp"),
        F.concat(F.lit('{"year": '), y, F.lit("}")).alias("evaluation_summary"), F.lit("v1").alias("feature_version"))
