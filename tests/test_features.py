import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import sentiment, technical
from marketloom.session import scratch_path
from marketloom.plans import feature_store, model_frame as mf
from marketloom.sources.schemas import TECHNICAL_COLUMNS


def market(spark, values=None, assets=(1,)):
    values = list(range(100, 150)) if values is None else values
    days = pd.bdate_range("2025-01-01", periods=len(values))
    rows = [(a, f"T{a}", d.date(), float(v), float(v + 1.5), float(v - 1.5), float(v), float(v), float(v), 1_000_000 + 10_000 * i)
            for a in assets for i, (d, v) in enumerate(zip(days, values))]
    return spark.createDataFrame(rows, "asset_id long, ticker string, price_date date, open_price double, high_price double, "
                                       "low_price double, close_price double, adjusted_close double, analysis_price double, volume long")


def news(spark):
    rows = [(1, "T1", dt.datetime(2025, 1, 5, 9), 0.6, "positive", "a"), (1, "T1", dt.datetime(2025, 1, 5, 15), -0.4, "Negative", "a"),
            (1, "T1", dt.datetime(2025, 1, 6, 9), 0.2, None, "a"), (1, "T1", dt.datetime(2025, 1, 8, 9), 0.5, "positive", "b")]
    return spark.createDataFrame(rows, "asset_id long, ticker string, published_at timestamp, sentiment_score double, "
                                       "sentiment_label string, source_name string")


def test_technical_vectors(spark):
    rows = technical.technical_features(market(spark), keep_targets_for=20).orderBy("feature_date").collect()
    assert rows[-1].momentum_20d == pytest.approx(20 / 129)
    assert rows[0].target_forward_return_20d == pytest.approx(0.2) and rows[0].target_negative_return_20d == 0
    assert rows[-1].target_forward_return_20d is None and rows[-1].target_negative_return_20d is None
    assert rows[19].rolling_volatility_20d is None and rows[20].rolling_volatility_20d is not None


def test_technical_against_pandas(spark):
    rng = np.random.default_rng(5)
    values = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, 90)))
    got = technical.technical_features(market(spark, values)).orderBy("feature_date").toPandas()
    p = pd.Series(values)
    r, lr, dd = p.pct_change(), np.log(p).diff(), p / p.cummax() - 1
    v = pd.Series([1_000_000.0 + 10_000 * i for i in range(90)])
    want = {
        "rolling_mean_return_5d": r.rolling(5).mean(), "rolling_volatility_10d": r.rolling(10).std(),
        "realized_volatility_20d": lr.rolling(20).std() * np.sqrt(252), "momentum_10d": p / p.shift(10) - 1,
        "ma_distance_20d": p / p.rolling(20).mean() - 1, "rolling_drawdown_20d": dd.rolling(20).min(),
        "downside_volatility_20d": r.clip(upper=0).rolling(20).std(), "return_lag_5d": r.shift(5),
        "volume_zscore_20d": (v - v.rolling(20).mean()) / v.rolling(20).std(), "volume_change_1d": v.pct_change()}
    for name, series in want.items():
        np.testing.assert_allclose(got[name].astype(float), series, rtol=1e-9, atol=1e-12, err_msg=name)
    assert [c for c in got.columns if c in TECHNICAL_COLUMNS] == TECHNICAL_COLUMNS


def test_gap_in_volume_breaks_the_window(spark):
    frame = market(spark).withColumn("volume", F.when(F.col("price_date") != F.lit("2025-02-03").cast("date"), F.col("volume")))
    rows = technical.technical_features(frame).orderBy("feature_date").collect()
    gap = next(i for i, r in enumerate(rows) if r.volume is None)
    assert rows[gap - 1].volume_ratio_20d is not None
    assert all(r.volume_ratio_20d is None for r in rows[gap:gap + 20]) and rows[gap + 20].volume_ratio_20d is not None


def test_one_exchange_for_all_windows(spark):
    stored = market(spark, assets=(1, 2, 3))
    plan = technical.technical_features(stored, keep_targets_for=20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_sentiment_vectors(spark):
    rows = sentiment.sentiment_features(news(spark)).orderBy("feature_date").collect()
    first = rows[0]
    assert first.article_count_1d == 2 and first.sentiment_mean_1d == pytest.approx(0.1)
    assert first.negative_article_share_7d == pytest.approx(0.5) and first.source_count_7d == 1
    assert first.sentiment_std_7d is None and rows[1].sentiment_std_7d is not None
    assert rows[2].article_count_7d == 4 and rows[2].negative_article_share_7d == pytest.approx(0.5 / 3)


def test_seven_days_are_rows_not_calendar_days(spark):
    rows = [(1, dt.datetime(2024, m, 1), 0.1 * m, "neutral", "s") for m in range(1, 10)]
    df = spark.createDataFrame(rows, "asset_id long, published_at timestamp, sentiment_score double, sentiment_label string, source_name string")
    last = sentiment.sentiment_features(df).orderBy(F.desc("feature_date")).first()
    assert last.article_count_7d == 7


def test_store_without_news(spark):
    frames = feature_store.feature_store_frames(market(spark))
    assert frames["training_frame"].count() == 50 and frames["sentiment_features"].count() == 0


def test_model_frame_has_62_features(spark):
    from marketloom.operators.reads import feature_columns
    frame = mf.model_frame(feature_store.feature_store_frames(market(spark, assets=(1, 2)), news(spark))["training_frame"])
    assert len(feature_columns(frame)) == 62 == len(mf.MODEL_FEATURES)


def test_benchmark_switch(spark):
    rows = feature_store.feature_store_frames(market(spark, assets=(1, 2)))["training_frame"]
    context = mf.trailing_context(rows)
    assert mf.benchmark_proxy(context).count() == 50
    one = context.withColumn("ticker", F.when(F.col("asset_id") == 1, "SPY").otherwise(F.col("ticker")))
    doubled = one.withColumn("daily_return", F.when(F.col("asset_id") == 2, 99.0).otherwise(F.col("daily_return")))
    assert mf.benchmark_proxy(doubled).agg(F.max("benchmark_daily_return")).first()[0] < 1


def test_benchmark_branch_reads_benchmarks_only(spark):
    """The proxy's filter by id passes below all windows into the scan, so only a few assets go through windows twice."""
    path = scratch_path(spark, "bars")
    market(spark, assets=(1, 2, 3)).withColumn("ticker", F.when(F.col("asset_id") == 3, "SPY").otherwise(F.col("ticker"))).write.parquet(path)
    rows = feature_store.feature_store_frames(spark.read.parquet(path))["training_frame"]
    assert mf.benchmark_assets(rows) == [3]
    proxy = mf.benchmark_proxy(rows, mf.trailing_context)
    plan = proxy._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(asset_id,3)" in plan and "Window" in plan
    whole = mf.trailing_context(rows).where("ticker = 'SPY'").groupBy("feature_date").agg(F.avg("daily_return").alias("r")).collect()
    assert {r.feature_date: r.benchmark_daily_return for r in proxy.collect()} == {r.feature_date: r.r for r in whole} and len(whole) == 50


def test_latest_rows_as_of(spark):
    rows = feature_store.feature_store_frames(market(spark, assets=(1, 2)))["training_frame"]
    got = mf.latest_rows(rows, dt.date(2025, 2, 1)).collect()
    assert len(got) == 2 and all(r.feature_date == dt.date(2025, 1, 31) for r in got)
