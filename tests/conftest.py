import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def prices(spark):
    """Series of one asset from plain numbers, on consecutive days."""
    import datetime as dt

    def make(values, asset_id=1, start=dt.date(2026, 1, 1), ticker="AAA"):
        rows = [(asset_id, ticker, start + dt.timedelta(days=i), float(v) if v is not None else None)
                for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "asset_id long, ticker string, price_date date, analysis_price double")
    return make
