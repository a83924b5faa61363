"""Model frame: derived ratios, benchmark-relative features, pillar scores and imputation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import ratio
from marketloom.operators.ranking import exact_quantiles
from marketloom.operators.windows import history, series
from marketloom.sources.schemas import NEGATIVE_TARGET, RETURN_TARGET, SENTIMENT_COLUMNS, TECHNICAL_COLUMNS, TRADING_DAYS

# fixed values: benchmark tickers
BENCHMARKS = ["SPY", "VOO", "IVV", "^GSPC"]

# fixed values: pillar components as (column, sign, scale, value for missing)
PILLARS = {
    "history_score": [
        ("momentum_5d", 1, 0.05, 0.0), ("trailing_return_20d", 1, 0.10, 0.0), ("trailing_return_60d", 1, 0.18, 0.0),
        ("moving_average_spread_10_20", 1, 0.04, 0.0), ("sharpe_like_ratio_20d", 1, 1.5, 0.0),
        ("benchmark_relative_momentum_20d", 1, 0.08, 0.0), ("volume_confirmation_20d", 1, 0.12, 0.0)],
    "risk_score": [
        ("realized_volatility_20d", -1, 0.45, 0.0), ("downside_volatility_20d", -1, 0.03, 0.0),
        ("drawdown_from_peak", 1, 0.20, 0.0), ("value_at_risk_20d", 1, 0.05, 0.0),
        ("expected_shortfall_20d", 1, 0.07, 0.0), ("stress_return_20d", 1, 0.10, 0.0),
        ("monte_carlo_downside_20d", 1, 0.10, 0.0), ("calm_20d", 1, 0.60, 0.0)],
    "sentiment_score": [
        ("sentiment_mean_7d", 1, 0.50, 0.0), ("sentiment_trend_7d", 1, 0.25, 0.0), ("sentiment_std_7d", -1, 0.40, 0.0),
        ("article_volume_zscore_30d", 1, 2.0, 0.0), ("combined_sentiment_score_7d", 1, 0.50, 0.0),
        ("positive_article_share_7d", 1, 0.60, 0.0), ("negative_article_share_7d", -1, 0.60, 0.0),
        ("source_count_7d", 1, 4.0, 0.0)],
}

# fixed values: names of the derived features
DERIVED_COLUMNS = [
    "trailing_return_20d", "trailing_return_60d", "moving_average_spread_10_20", "sharpe_like_ratio_20d",
    "trend_strength_20d", "volume_confirmation_20d", "value_at_risk_20d", "expected_shortfall_20d",
    "volatility_regime_20d", "drawdown_regime_20d", "stress_return_20d", "monte_carlo_downside_20d",
    "downside_ratio_20d", "sentiment_trend_7d", "sentiment_change_7d", "article_volume_zscore_30d",
    "combined_sentiment_score_7d", "benchmark_daily_return", "benchmark_momentum_20d", "benchmark_momentum_60d",
    "benchmark_relative_return_1d", "benchmark_relative_momentum_20d", "benchmark_relative_return_60d",
    "history_score", "risk_score", "sentiment_score", "pillar_composite_pre_ml",
]
MODEL_FEATURES = TECHNICAL_COLUMNS + SENTIMENT_COLUMNS + DERIVED_COLUMNS

# fixed values: pillar of each feature, used by weights, contributions and importances
FEATURE_GROUPS = {
    "history": [
        "momentum_5d", "momentum_10d", "momentum_20d", "trailing_return_20d", "trailing_return_60d",
        "moving_average_spread_10_20", "ma_distance_10d", "ma_distance_20d", "rolling_mean_return_20d",
        "sharpe_like_ratio_20d", "trend_strength_20d", "volume_ratio_20d", "volume_confirmation_20d",
        "benchmark_relative_return_1d", "benchmark_relative_momentum_20d", "benchmark_relative_return_60d",
        "history_score"],
    "risk": [
        "rolling_volatility_20d", "realized_volatility_20d", "recent_realized_volatility_5d",
        "downside_volatility_20d", "drawdown_from_peak", "rolling_drawdown_20d", "value_at_risk_20d",
        "expected_shortfall_20d", "volatility_regime_20d", "drawdown_regime_20d", "stress_return_20d",
        "monte_carlo_downside_20d", "downside_ratio_20d", "risk_score"],
    "sentiment": [
        "article_count_1d", "article_count_7d", "source_count_7d", "sentiment_mean_1d", "sentiment_mean_7d",
        "sentiment_std_7d", "sentiment_trend_7d", "sentiment_change_7d", "negative_article_share_7d",
        "positive_article_share_7d", "article_volume_zscore_30d", "source_sentiment_dispersion_7d",
        "combined_sentiment_score_7d", "sentiment_score"],
}
PILLAR_OF = {f: g for g, fs in FEATURE_GROUPS.items() for f in fs}


#: Rows of the article z-score.
ARTICLE_DAYS = 30


def trailing_context(training: DataFrame) -> DataFrame:
    """60-row return, sentiment change against 7 rows back, 30-row article z-score (5 rows at least).

    Sums over 30 rows are differences of running sums, which are exact because article counts are whole numbers: no frame slides.
    """
    w = series("feature_date")
    p, n = F.col("analysis_price"), F.col("article_count_1d")
    frame = training.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in SENTIMENT_COLUMNS})
    until, before = history("feature_date"), w.rowsBetween(Window.unboundedPreceding, -ARTICLE_DAYS)
    running = {"rows": F.count("*"), "total": F.sum(n), "squares": F.sum(n * n)}

    def last(name):
        return F.col(f"_{name}_until") - F.coalesce(f"_{name}_before", F.lit(0))
    rows, total = last("rows"), last("total")
    spread = F.sqrt(ratio(rows * last("squares") - total * total, rows * (rows - 1)))
    return frame.withColumns({
        "_price_60": F.lag(p, 60).over(w), "_mean_7": F.lag("sentiment_mean_7d", 7).over(w),
        **{f"_{name}_until": what.over(until) for name, what in running.items()},
        **{f"_{name}_before": what.over(before) for name, what in running.items()},
    }).withColumns({
        "trailing_return_60d": ratio(p, F.col("_price_60")) - 1.0,
        "sentiment_change_7d": F.col("sentiment_mean_7d") - F.col("_mean_7"),
        "article_volume_zscore_30d": F.when(rows >= 5, ratio(n - total / rows, spread)),
    }).drop("_price_60", "_mean_7", *[f"_{name}_{end}" for name in running for end in ("until", "before")])


def derived_ratios(frame: DataFrame) -> DataFrame:
    c = F.col
    day_20 = c("realized_volatility_20d") / F.sqrt(F.lit(float(TRADING_DAYS)))
    day_5 = c("recent_realized_volatility_5d") / F.sqrt(F.lit(float(TRADING_DAYS)))
    z = F.coalesce("article_volume_zscore_30d", F.lit(0.0))
    return frame.withColumns({
        "trailing_return_20d": c("momentum_20d"),
        "moving_average_spread_10_20": c("ma_distance_10d") - c("ma_distance_20d"),
        "sharpe_like_ratio_20d": ratio(c("rolling_mean_return_20d"), c("rolling_volatility_20d")),
        "trend_strength_20d": ratio(c("momentum_20d"), c("realized_volatility_20d")),
        "volume_confirmation_20d": c("momentum_20d") * c("volume_ratio_20d"),
        "value_at_risk_20d": c("rolling_mean_return_20d") - 1.65 * c("rolling_volatility_20d"),
        "expected_shortfall_20d": c("rolling_mean_return_20d") - 2.06 * c("rolling_volatility_20d"),
        "volatility_regime_20d": ratio(day_5, day_20),
        "drawdown_regime_20d": c("drawdown_from_peak") - c("rolling_drawdown_20d"),
        "stress_return_20d": c("momentum_20d") - 1.65 * c("realized_volatility_20d") * F.sqrt(F.lit(20.0 / TRADING_DAYS)),
        "monte_carlo_downside_20d": 20.0 * c("rolling_mean_return_20d") - 1.65 * day_20 * F.sqrt(F.lit(20.0)),
        "downside_ratio_20d": ratio(c("downside_volatility_20d"), c("rolling_volatility_20d")),
        "sentiment_trend_7d": c("sentiment_mean_1d") - c("sentiment_mean_7d"),
        "combined_sentiment_score_7d": (
            0.55 * c("sentiment_mean_7d")
            + 0.20 * (c("positive_article_share_7d") - c("negative_article_share_7d"))
            + 0.15 * F.tanh(z / 2.0) + 0.10 * F.tanh(c("source_count_7d") / 4.0)),
    })


_BENCHMARK_COLUMNS = {"benchmark_daily_return": "daily_return", "benchmark_momentum_20d": "momentum_20d",
                      "benchmark_momentum_60d": "trailing_return_60d"}


def benchmark_assets(frame: DataFrame) -> list[int]:
    """Ids of the benchmark tickers that have rows in the frame. Tickers are unique, so these are no more than ``BENCHMARKS``."""
    rows = frame.where(F.col("ticker").isin(BENCHMARKS)).select("asset_id").distinct()  # no join, no window is left below
    return sorted(r["asset_id"] for r in rows.collect() if r["asset_id"] is not None)


def benchmark_proxy(frame: DataFrame, build: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Per-date mean of the benchmark tickers, or of all assets when the frame holds no benchmark.

    ``build`` adds the columns of one asset's series that ``frame`` lacks. The benchmarks' ids are looked up first, a job that reads keys
    only: a filter by id passes below every window over an asset's rows down to the bars, so the windows run over all assets once, and for the proxy over a few.
    """
    ids = benchmark_assets(frame)
    used = build(frame.where(F.col("asset_id").isin(ids)) if ids else frame)
    return used.where(F.col("ticker").isin(BENCHMARKS) | F.lit(not ids)).groupBy("feature_date").agg(
        *[F.avg(s).alias(n) for n, s in _BENCHMARK_COLUMNS.items()])


def benchmark_relative(frame: DataFrame, proxy: DataFrame | None = None) -> DataFrame:
    """One proxy row per date is joined on: its size is bounded by the calendar, so it is broadcast."""
    return frame.join(F.broadcast(benchmark_proxy(frame) if proxy is None else proxy), "feature_date", "left").withColumns({
        "benchmark_relative_return_1d": F.col("daily_return") - F.col("benchmark_daily_return"),
        "benchmark_relative_momentum_20d": F.col("momentum_20d") - F.col("benchmark_momentum_20d"),
        "benchmark_relative_return_60d": F.col("trailing_return_60d") - F.col("benchmark_momentum_60d"),
    })


def pillar_scores(frame: DataFrame) -> DataFrame:
    def mean_tanh(parts):
        terms = [F.tanh(F.coalesce(sign * F.col(c), F.lit(fill)) / scale) for c, sign, scale, fill in parts]
        return reduce(lambda a, b: a + b, terms) / float(len(terms))
    calm = 1.0 - F.coalesce("volatility_regime_20d", F.lit(1.0))
    scored = frame.withColumn("calm_20d", calm).withColumns({n: mean_tanh(p) for n, p in PILLARS.items()}).drop("calm_20d")
    composite = reduce(lambda a, b: a + b, [F.col(n) for n in PILLARS]) / 3.0
    return scored.withColumn("pillar_composite_pre_ml", composite)


def model_frame(training: DataFrame) -> DataFrame:
    """All 62 features with keys and targets; missing values are still NULL."""
    proxy = benchmark_proxy(training, trailing_context)
    enriched = pillar_scores(benchmark_relative(derived_ratios(trailing_context(training)), proxy))
    keys = [c for c in ("asset_id", "ticker", "feature_date") if c in enriched.columns]
    targets = [c for c in (RETURN_TARGET, NEGATIVE_TARGET) if c in enriched.columns]
    return enriched.select(*keys, *targets, *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES])


def column_medians(frame: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians over the whole frame; 0 for a column without any value."""
    return {c: 0.0 if m is None else m for c, m in exact_quantiles(frame, columns, 0.5).items()}


def impute(frame: DataFrame, medians: dict[str, float]) -> DataFrame:
    return frame.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items()})


def latest_rows(frame: DataFrame, as_of=None) -> DataFrame:
    """Latest row per asset, on or before ``as_of``."""
    rows = frame if as_of is None else frame.where(F.col("feature_date") <= F.lit(as_of).cast("date"))
    after = F.lead("feature_date").over(series("feature_date"))  # one row per asset and date: the last has none after it
    return rows.withColumn("_after", after).where(F.col("_after").isNull()).drop("_after")
