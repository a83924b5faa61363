"""Return series and per-asset return totals. Input: asset_id, price_date, price column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.columns import ratio
from marketloom.operators.windows import history, series
from marketloom.sources.schemas import TRADING_DAYS


def daily_return(price, w=None):
    w = w or series()
    return ratio(price, F.lag(price).over(w)) - 1.0


def return_frame(bars: DataFrame, price: str = "analysis_price") -> DataFrame:
    """Daily, cumulative and log return; the first row has cumulative return 0 and no daily return."""
    p = F.col(price)
    return bars.where(p.isNotNull()).select(
        "asset_id", "price_date", p.alias("price"),
        daily_return(p).alias("daily_return"),
        (ratio(p, F.first(p).over(history())) - 1.0).alias("cumulative_return"),
        (F.ln(p) - F.lag(F.ln(p)).over(series())).alias("log_return"),
    )


def cumulative_return_series(bars: DataFrame, price: str = "analysis_price") -> DataFrame:
    """Cumulative return from the first return on (the starting row is left out)."""
    frame = return_frame(bars, price)
    return frame.where(F.col("daily_return").isNotNull()).select("asset_id", "price_date", "cumulative_return")


def return_totals(bars: DataFrame, price: str = "analysis_price", periods_per_year: int = TRADING_DAYS) -> DataFrame:
    """Total and annualized return per asset, one partially aggregated pass over the bars."""
    p, d = F.col(price), F.col("price_date")
    ends = bars.where(p.isNotNull()).groupBy("asset_id").agg(
        F.count("*").alias("price_count"),
        F.min_by(p, d).alias("first_price"),
        F.max_by(p, d).alias("last_price"),
    )
    growth = ratio(F.col("last_price"), F.col("first_price"))
    enough = F.col("price_count") >= 2
    years = F.lit(float(periods_per_year)) / F.nullif(F.col("price_count") - 1, F.lit(0))
    return ends.select(
        "asset_id", "price_count", "first_price", "last_price",
        F.when(enough, growth - 1.0).alias("total_return"),
        F.when(enough & (growth > 0), F.pow(growth, years) - 1.0).alias("annualized_return"),
    )
