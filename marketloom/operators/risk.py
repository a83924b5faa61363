"""Risk series and per-asset risk summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.columns import ratio
from marketloom.operators.returns import daily_return
from marketloom.operators.windows import full_window, history, last_rows, whole
from marketloom.sources.schemas import TRADING_DAYS


def annualize(volatility, periods_per_year: int = TRADING_DAYS):
    return volatility * F.sqrt(F.lit(float(periods_per_year)))


def drawdown_series(bars: DataFrame, price: str = "analysis_price") -> DataFrame:
    p = F.col(price)
    peak = F.max(p).over(history())
    return bars.where(p.isNotNull()).select(
        "asset_id", "price_date", p.alias("price"), peak.alias("running_peak"),
        (ratio(p, peak) - 1.0).alias("drawdown"))


def rolling_volatility(bars: DataFrame, window: int = 21, price: str = "analysis_price",
                       periods_per_year: int = TRADING_DAYS) -> DataFrame:
    p, r = F.col(price), F.col("daily_return")
    frame = bars.where(p.isNotNull()).select("asset_id", "price_date", daily_return(p).alias("daily_return"))
    rolled = full_window(F.stddev_samp(r), r, window, last_rows(window))
    return frame.withColumn("rolling_volatility", annualize(rolled, periods_per_year))


def risk_frame(bars: DataFrame, price: str = "analysis_price", confidence_level: float = 0.95,
               volatility_window: int = 21, periods_per_year: int = TRADING_DAYS) -> DataFrame:
    """Row-level inputs of the risk summary, with the asset's VaR cutoff already on every row.

    The cutoff is a window over the same series, so it costs neither a join nor a second shuffle.
    """
    p, r = F.col(price), F.col("daily_return")
    peak = F.max(p).over(history())
    base = bars.where(p.isNotNull()).select(
        "asset_id", "price_date", p.alias("price"), daily_return(p).alias("daily_return"),
        (ratio(p, peak) - 1.0).alias("drawdown"))
    rolled = full_window(F.stddev_samp(r), r, volatility_window, last_rows(volatility_window))
    return base.select(
        "*", annualize(rolled, periods_per_year).alias("rolling_volatility"),
        F.percentile(r, F.lit(1.0 - confidence_level)).over(whole()).alias("cutoff"))


def risk_summary(bars: DataFrame, price: str = "analysis_price", confidence_level: float = 0.95,
                 volatility_window: int = 21, periods_per_year: int = TRADING_DAYS) -> DataFrame:
    """Volatility, drawdown, VaR, expected shortfall and latest rolling volatility per asset.

    The windows leave the rows partitioned by asset, so the final aggregation needs no further shuffle.
    """
    rows = risk_frame(bars, price, confidence_level, volatility_window, periods_per_year)
    r = F.col("daily_return")
    return rows.groupBy("asset_id").agg(
        F.count(r).alias("return_count"),
        annualize(F.stddev_samp(r), periods_per_year).alias("annualized_volatility"),
        F.min("drawdown").alias("max_drawdown"),
        (-F.max("cutoff")).alias("historical_var"),
        (-F.avg(F.when(r <= F.col("cutoff"), r))).alias("expected_shortfall"),
        F.max_by("rolling_volatility",
                 F.when(F.col("rolling_volatility").isNotNull(), F.col("price_date"))).alias("latest_rolling_volatility"),
    )
