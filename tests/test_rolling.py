"""Rolling statistics put together from halves, against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from checks.base import rounded
from marketloom.operators.rolling import with_rolled
from marketloom.operators.technical import technical_features
from marketloom.plans.model_frame import trailing_context
from marketloom.sources.schemas import SENTIMENT_COLUMNS


def test_every_size_equals_pandas(spark):
    rng = np.random.default_rng(5)
    parts = []
    for asset in (1, 2, None):
        x = rng.normal(1e6, 1e-2, 70)
        x[rng.integers(0, 70, 2)] = np.nan
        x[30:62] = 7.25  # equal values deviate by exactly zero
        parts.append(pd.DataFrame({"asset_id": asset, "price_date": pd.date_range("2024-01-01", periods=70).date, "x": x}))
    rows = pd.concat(parts, ignore_index=True).astype({"asset_id": "Int64"})
    frame = spark.createDataFrame([(None if pd.isna(a) else int(a), d, None if np.isnan(v) else float(v)) for a, d, v in rows.itertuples(index=False)],
                                  "asset_id long, price_date date, x double")
    sizes = [2, 3, 5, 7, 10, 20, 30]
    wanted = {f"{kind}_{n}": (kind, "x", n) for n in sizes for kind in ("avg", "stddev_samp", "min")}
    got = with_rolled(frame, wanted)
    assert got.columns == [*frame.columns, *wanted]
    got = got.toPandas().sort_values(["asset_id", "price_date"], na_position="last").reset_index(drop=True)
    groups = rows.groupby("asset_id", dropna=False, sort=False)["x"]
    for n in sizes:
        np.testing.assert_allclose(got[f"avg_{n}"], groups.transform(lambda v: v.rolling(n).mean()), rtol=1e-9)
        direct = groups.transform(lambda v: v.rolling(n).apply(lambda w: np.std(w - w[0], ddof=1), raw=True))
        np.testing.assert_allclose(got[f"stddev_samp_{n}"], direct, rtol=1e-6, atol=1e-10)
        assert (got[f"stddev_samp_{n}"][(direct == 0)] == 0).all() and (direct == 0).any()
        np.testing.assert_allclose(got[f"min_{n}"], groups.transform(lambda v: v.rolling(n, min_periods=1).min()))


def test_technical_features_have_no_sliding_frame(spark, prices):
    bars = prices([1.0] * 30).selectExpr("*", "analysis_price as close_price", "analysis_price as adjusted_close", "5L as volume",
                                         "analysis_price as high_price", "analysis_price as low_price")
    plan = technical_features(bars)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "specifiedwindowframe(RowFrame, -19, currentrow$())" not in plan and plan.count("Exchange") == 1


def test_rounding_goes_away_from_zero(spark):
    values = [0.5, 1.5, 2.5, -0.5, -2.5, 1.25, -1.26, 1e300, -0.04, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(rounded("v", 0)).collect()]
    assert got[:9] == [1.0, 2.0, 3.0, -1.0, -3.0, 1.0, -1.0, 1e300, 0.0] and str(got[8]) == "0.0" and got[9] == float("inf") and np.isnan(got[10]) and got[11] is None
    assert [r[0] for r in df.where("i < 7").orderBy("i").select(F.col("v"), rounded("v", 1)).select(F.col("v")).collect()] == values[:7]
    assert spark.range(1).select(F.lit(0.15).alias("v")).select(rounded("v", 1)).first()[0] == 0.2


def window_operators(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Window [")


def test_all_sizes_take_two_window_operators(spark, prices):
    wanted = {f"{kind}_{n}": (kind, "analysis_price", n) for n in (5, 10, 20) for kind in ("avg", "stddev_samp", "min")}
    assert window_operators(with_rolled(prices([1.0] * 30), wanted)) == 2


def test_equal_values_deviate_by_zero_whatever_their_digits(spark, prices):
    wanted = {f"std_{n}": ("stddev_samp", "analysis_price", n) for n in (3, 7, 13, 20)}
    for value in (0.1, 1 / 3, 1e9 + 0.7):
        last = with_rolled(prices([value] * 21), wanted).orderBy(F.desc("price_date")).first()
        assert [last[c] for c in wanted] == [0.0] * len(wanted)


def test_trailing_context_has_no_sliding_frame(spark):
    counts = [int(c) for c in np.random.default_rng(8).integers(0, 40, 80)]
    counts[36:70] = [7] * 34
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0, c if i % 9 else None) for i, c in enumerate(counts)],
                                 "asset_id long, feature_date date, analysis_price double, article_count_1d long")
    frame = rows.withColumns({c: F.lit(0.5) for c in SENTIMENT_COLUMNS if c != "article_count_1d"})
    got = trailing_context(frame)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "-29, currentrow$()" not in plan and window_operators(got) == 1
    n = pd.Series([float(c) if i % 9 else 0.0 for i, c in enumerate(counts)])
    month = n.rolling(30, min_periods=5)
    want = (n - month.mean()) / month.std()
    values = [r.article_volume_zscore_30d for r in got.orderBy("feature_date").collect()]
    np.testing.assert_allclose([np.nan if v is None else v for v in values], want, rtol=1e-9)
    same = frame.withColumn("article_count_1d", F.lit(7))
    assert {r.article_volume_zscore_30d for r in trailing_context(same).collect()} == {None}
