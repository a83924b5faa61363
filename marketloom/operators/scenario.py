"""Drift and volatility per asset, from history or informed by a stored forecast."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.returns import daily_return
from marketloom.sources.schemas import TRADING_DAYS


def scenario_inputs(bars: DataFrame, price: str = "analysis_price", periods_per_year: int = TRADING_DAYS) -> DataFrame:
    """Daily and annualized drift and volatility per asset; assets with fewer than two returns are left out."""
    p, r = F.col(price), F.col("r")
    rows = bars.where(p.isNotNull()).select("asset_id", "price_date", p.alias("p"), daily_return(p).alias("r"))
    stats = rows.groupBy("asset_id").agg(
        F.max_by("p", "price_date").alias("starting_price"), F.avg(r).alias("daily_drift"),
        F.stddev_samp(r).alias("daily_volatility"), F.count(r).alias("observations"))
    return annualized(stats.where(F.col("observations") >= 2), periods_per_year)


def annualized(inputs: DataFrame, periods_per_year: int = TRADING_DAYS) -> DataFrame:
    return inputs.withColumns({
        "annualized_drift": F.col("daily_drift") * float(periods_per_year),
        "annualized_volatility": F.col("daily_volatility") * math.sqrt(periods_per_year)})


def forecast_inputs(historical: DataFrame, forecasts: DataFrame, periods_per_year: int = TRADING_DAYS) -> DataFrame:
    """Inputs informed by the stored forecast; an asset without one keeps its historical inputs.

    ``forecasts``: asset_id, prediction_horizon_days, predicted_return_20d, downside_probability_20d,
    predicted_volatility_20d, downside_volatility_20d.
    """
    f = forecasts.select(
        "asset_id", F.coalesce(F.nullif("prediction_horizon_days", F.lit(0)), F.lit(20)).cast("double").alias("h"),
        "predicted_return_20d", "downside_probability_20d", "predicted_volatility_20d", "downside_volatility_20d",
        F.lit(True).alias("has_forecast"))
    old = F.col("daily_volatility")
    drift = F.when(F.col("h") > 0, F.col("predicted_return_20d") / F.col("h"))
    volatility = F.coalesce(F.col("predicted_volatility_20d") / math.sqrt(periods_per_year),
                            F.when(F.col("downside_volatility_20d").isNotNull(),
                                   F.greatest(old, F.col("downside_volatility_20d"))), old)
    joined = historical.join(f, "asset_id", "left").withColumns({
        "daily_drift": F.coalesce(drift, F.col("daily_drift")), "daily_volatility": volatility,
        "forecast_horizon_days": F.when(F.col("has_forecast"), F.col("h")),
        "downside_probability": F.col("downside_probability_20d")})
    return annualized(joined, periods_per_year).select(*historical.columns, "forecast_horizon_days", "downside_probability")
