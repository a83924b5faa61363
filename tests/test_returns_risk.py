import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import returns, risk


def test_return_vectors(prices):
    rows = returns.return_frame(prices([100, 110, 121])).orderBy("price_date").collect()
    assert rows[0].daily_return is None and rows[0].cumulative_return == 0.0
    assert [round(r.daily_return, 9) for r in rows[1:]] == [0.1, 0.1]
    assert rows[2].cumulative_return == pytest.approx(0.21)
    assert rows[1].log_return == pytest.approx(math.log(1.1))
    assert returns.cumulative_return_series(prices([100, 110, 121])).count() == 2


def test_totals(prices):
    row = returns.return_totals(prices([100, 110, 121]), periods_per_year=2).first()
    assert row.total_return == pytest.approx(0.21)
    assert row.annualized_return == pytest.approx(0.21)


def test_totals_need_two_prices(prices):
    row = returns.return_totals(prices([100])).first()
    assert row.total_return is None and row.annualized_return is None


def test_missing_prices_are_skipped(prices):
    rows = returns.return_frame(prices([100, None, 110])).collect()
    assert len(rows) == 2 and max(r.daily_return or 0 for r in rows) == pytest.approx(0.1)


def test_zero_price_gives_null_not_error(prices):
    rows = returns.return_frame(prices([100, 0, 50])).orderBy("price_date").collect()
    assert rows[1].daily_return == -1.0 and rows[2].daily_return is None


def test_drawdown(prices):
    frame = risk.drawdown_series(prices([100, 120, 90, 95, 80]))
    assert frame.agg(F.min("drawdown")).first()[0] == pytest.approx(-1 / 3)


def test_var_and_shortfall_vectors(spark):
    rows = spark.createDataFrame([(1, r) for r in (-0.02, 0.01, -0.03, 0.02, -0.01)], "asset_id int, r double")
    q = rows.agg(F.percentile("r", 0.2)).first()[0]
    assert -q == pytest.approx(0.022)
    assert -rows.where(F.col("r") <= q).agg(F.avg("r")).first()[0] == pytest.approx(0.03)


def test_rolling_volatility_waits_for_a_full_window(prices):
    rows = risk.rolling_volatility(prices([100, 101, 99, 104, 103]), window=3).orderBy("price_date").collect()
    assert [r.rolling_volatility is None for r in rows] == [True, True, True, False, False]
    r = np.array([101 / 100, 99 / 101, 104 / 99]) - 1
    assert rows[3].rolling_volatility == pytest.approx(r.std(ddof=1) * math.sqrt(252))


def test_risk_summary_against_numpy(prices):
    rng = np.random.default_rng(3)
    p = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 120)))
    row = risk.risk_summary(prices(p), confidence_level=0.9).first()
    r = p[1:] / p[:-1] - 1
    cut = np.quantile(r, 0.1)
    assert row.annualized_volatility == pytest.approx(r.std(ddof=1) * math.sqrt(252))
    assert row.historical_var == pytest.approx(-cut)
    assert row.expected_shortfall == pytest.approx(-r[r <= cut].mean())
    assert row.max_drawdown == pytest.approx((p / np.maximum.accumulate(p) - 1).min())
    assert row.latest_rolling_volatility == pytest.approx(r[-21:].std(ddof=1) * math.sqrt(252))
