"""Checks of drift and volatility per asset."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import BLOCKS, check
from checks.features import latest
from marketloom.operators import scenario as sc
from marketloom.sources import demo_universe as u

BLOCKS["x_input"] = """
select asset_id, last_price as starting_price, daily_drift, daily_volatility, return_count as observations,
       daily_drift * 252 as annualized_drift, daily_volatility * sqrt(252.0) as annualized_volatility
from x_kpi where return_count >= 2
"""
_INPUTS = "daily_drift daily_volatility annualized_drift annualized_volatility"


@check("a18_scenario_inputs", f"select asset_id, starting_price, {', '.join(_INPUTS.split())}, observations from x_input", rounds=_INPUTS)
def _(spark, sf):
    return sc.scenario_inputs(u.bars(spark, sf))


_N4 = "daily_drift daily_volatility annualized_drift annualized_volatility downside_probability"
BLOCKS["x_informed"] = """
select i.asset_id, starting_price, predicted_return_20d / 20 as daily_drift,
  coalesce(realized_volatility_20d / sqrt(252.0), greatest(daily_volatility, downside_volatility_20d)) as daily_volatility,
  observations, 20.0::double as forecast_horizon_days, downside_probability_20d as downside_probability
from x_input i join x_latest p on p.asset_id = i.asset_id
"""


def forecasts(spark, sf):
    return latest(spark, sf).withColumn("predicted_volatility_20d", F.col("realized_volatility_20d"))


@check("n04_forecast_inputs", """
select asset_id, starting_price, daily_drift, daily_volatility, observations, daily_drift * 252 as annualized_drift,
  daily_volatility * sqrt(252.0) as annualized_volatility, forecast_horizon_days, downside_probability from x_informed""", rounds=_N4)
def _(spark, sf):
    return sc.forecast_inputs(sc.scenario_inputs(u.bars(spark, sf)), forecasts(spark, sf))
