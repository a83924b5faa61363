"""Technical features and forward targets, for the whole universe in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import ratio
from marketloom.operators.risk import annualize
from marketloom.operators.rolling import with_rolled
from marketloom.operators.windows import history, series
from marketloom.sources.schemas import FEATURE_VERSION, TECHNICAL_COLUMNS


#: Rolling statistics as (statistic, column, rows).
ROLLED = {
    **{f"rolling_mean_return_{n}d": ("avg", "daily_return", n) for n in (5, 20)},
    **{f"rolling_volatility_{n}d": ("stddev_samp", "daily_return", n) for n in (10, 20)},
    "realized_20d": ("stddev_samp", "log_return", 20), "realized_5d": ("stddev_samp", "log_return", 5),
    **{f"mean_price_{n}d": ("avg", "analysis_price", n) for n in (10, 20)},
    "least_drawdown_20d": ("min", "drawdown_from_peak", 20),
    "downside_volatility_20d": ("stddev_samp", "downside_return", 20),
    "mean_volume_20d": ("avg", "volume", 20), "std_volume_20d": ("stddev_samp", "volume", 20),
}


def technical_features(bars: DataFrame, price: str = "analysis_price", keep_targets_for: int | None = None) -> DataFrame:
    """Feature table W1-W15 with a version tag, in storage order.

    All windows share one partitioning and order: one exchange, one sort. ``keep_targets_for`` adds
    the forward targets of that horizon from the same pass.
    """
    w = series()
    p, v = F.col("analysis_price"), F.col("volume").cast("double")
    base = bars.withColumn("analysis_price", F.col(price).cast("double")).where(p.isNotNull())
    # lags by name, so that one window operator gives all of them; returns of earlier rows are made from earlier prices
    lagged = base.withColumns({
        **{f"_price_{k}": F.lag(p, k).over(w) for k in (1, 2, 5, 6, 10, 11, 20)},
        "_peak": F.max(p).over(history()), "_volume_1": F.lag("volume").over(w),
        **({"future_price": F.lead(p, keep_targets_for).over(w)} if keep_targets_for else {}),
    })

    def price_of(k):
        return F.col(f"_price_{k}") if k else p

    def daily_return(k):
        return ratio(price_of(k), price_of(k + 1)) - 1.0
    level_1 = lagged.select(
        *[c for c in ("asset_id", "ticker") if c in bars.columns],
        F.col("price_date"), p, F.col("close_price").cast("double"), F.col("adjusted_close").cast("double"),
        F.col("volume"), F.col("high_price").cast("double"), F.col("low_price").cast("double"),
        daily_return(0).alias("daily_return"), (F.ln(p) - F.ln(price_of(1))).alias("log_return"),
        (ratio(p, F.col("_peak")) - 1.0).alias("drawdown_from_peak"),
        *[(ratio(p, price_of(k)) - 1.0).alias(f"momentum_{k}d") for k in (5, 10, 20)],
        (ratio(v, F.col("_volume_1").cast("double")) - 1.0).alias("volume_change_1d"),
        *[daily_return(k).alias(f"return_lag_{k}d") for k in (1, 5, 10)],
        *(["future_price"] if keep_targets_for else []),
    ).withColumn("downside_return", F.when(F.col("daily_return").isNotNull(),
                                           F.least(F.col("daily_return"), F.lit(0.0))))
    level_2 = with_rolled(level_1, ROLLED)
    volume_mean, volume_std = F.col("mean_volume_20d"), F.col("std_volume_20d")
    computed = {
        "realized_volatility_20d": annualize(F.col("realized_20d")),
        "recent_realized_volatility_5d": annualize(F.col("realized_5d")),
        **{f"ma_distance_{n}d": ratio(p, F.col(f"mean_price_{n}d")) - 1.0 for n in (10, 20)},
        "rolling_drawdown_20d": F.when(F.col("mean_price_20d").isNotNull(), F.col("least_drawdown_20d")),
        "intraday_range_pct": ratio(F.col("high_price") - F.col("low_price"), p),
        "volume_ratio_20d": ratio(v, volume_mean),
        "volume_zscore_20d": ratio(v - volume_mean, volume_std),
    }
    targets = []
    if keep_targets_for:
        forward = ratio(F.col("future_price"), p) - 1.0
        targets = [forward.alias(f"target_forward_return_{keep_targets_for}d"),
                   (forward < 0).cast("int").alias(f"target_negative_return_{keep_targets_for}d")]
    return level_2.select(
        *[c for c in ("asset_id", "ticker") if c in bars.columns],
        F.col("price_date").alias("feature_date"),
        *[computed[c].alias(c) if c in computed else F.col(c) for c in TECHNICAL_COLUMNS],
        *targets,
        F.lit(FEATURE_VERSION).alias("feature_version"),
    )


def forward_targets(bars: DataFrame, horizon_days: int = 20, price: str = "analysis_price") -> DataFrame:
    """Forward return and its negative flag; both missing where the horizon runs past the series."""
    p = F.col(price).cast("double")
    forward = ratio(F.lead(p, horizon_days).over(series()), p) - 1.0
    return bars.where(p.isNotNull()).select(
        "asset_id", F.col("price_date").alias("feature_date"),
        forward.alias(f"target_forward_return_{horizon_days}d"),
    ).withColumn(f"target_negative_return_{horizon_days}d",
                 (F.col(f"target_forward_return_{horizon_days}d") < 0).cast("int"))


def attach_targets(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Left join on (asset_id, feature_date)."""
    return features.join(targets, ["asset_id", "feature_date"], "left")
