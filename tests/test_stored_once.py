"""What a model query or a merge keeps on disk or in memory."""

import datetime as dt
import glob

import pytest
from pyspark import StorageLevel

import checks.models as queries
from marketloom import session
from marketloom.plans import train
from marketloom.session import scratch_path, shared_folder
from marketloom.sources.monthly import MonthlyTable


def test_imputed_frame_is_not_stored_beside_the_raw_one(spark, monkeypatch):
    raw = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "asset_id long, a double")
    monkeypatch.setattr(queries, "model_rows", lambda spark, sf: raw)
    frame = queries.imputed(spark, "", ["a"])
    assert sorted(r.a for r in frame.collect()) == [1.0, 2.0, 3.0]
    assert raw.storageLevel.useMemory and not frame.storageLevel.useMemory
    raw.unpersist()


def test_many_rows_are_fitted_one_model_after_the_other():
    assert train.fits_at_once(0) == train.fits_at_once(500_000) == train.FITS_AT_ONCE
    assert train.fits_at_once(3_200_000) == 2 and train.fits_at_once(32_000_000) == 1


def test_merge_deletes_its_copy(spark):
    def copies():
        return set(glob.glob(f"{shared_folder(spark)}/months-*".replace("file:", "")))
    table, before = MonthlyTable(spark, scratch_path(spark, "m"), "technical_features", ["feature_version"]), copies()
    for version in ("v1", "v2"):
        rows = [(1, "A", dt.date(2024, 1, 2), 0.5, version), (None, "B", dt.date(2024, 1, 2), 0.5, version)]
        assert table.merge(spark.createDataFrame(rows, "asset_id long, ticker string, feature_date date, daily_return double, feature_version string")) == ["2024-01"]
    assert copies() == before
    assert [(r.asset_id, r.feature_version) for r in table.current().orderBy("asset_id").collect()] == [(None, "v2"), (1, "v2")]


def test_large_input_is_not_stored(spark, tmp_path, monkeypatch):
    """Frames over much input are made anew per pass; what they are made from counts once, rows without a file do not."""
    spark.range(1000).withColumnRenamed("id", "a").write.parquet(f"{tmp_path}/t")
    frame = spark.read.parquet(f"{tmp_path}/t")
    made = spark.createDataFrame([(1,)], "a long")
    size = session.input_bytes(frame)
    assert 0 < size < 100_000 and session.input_bytes(frame.join(frame.groupBy("a").count(), "a").join(made, "a", "left")) == size and session.input_bytes(made) == 0
    small = session.kept(frame)
    assert small.storageLevel.useDisk and small.storageLevel.useMemory
    small.unpersist()
    monkeypatch.setattr(session, "STORED_INPUT_BYTES", size - 1)
    assert session.kept(frame).storageLevel == StorageLevel.NONE and session.kept(made).storageLevel.useMemory
    raw = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(queries, "model_rows", lambda spark, sf: raw)
    assert queries.imputed(spark, "", ["a"]).count() == 1000 and raw.storageLevel == StorageLevel.NONE


def test_merge_copies_nothing(spark, monkeypatch):
    table = MonthlyTable(spark, scratch_path(spark, "m"), "technical_features", ["feature_version"])

    def rows(*found):
        return spark.createDataFrame([(a, "A", dt.date(2024, m, 2), x, v) for a, m, x, v in found],
                                     "asset_id long, ticker string, feature_date date, daily_return double, feature_version string")
    table.merge(rows((1, 1, 0.5, "v1"), (2, 1, 0.5, "v1"), (1, 2, 0.5, "v1")))
    monkeypatch.setattr("marketloom.session.scratch_path", lambda *_: pytest.fail("a copy is written"))
    assert table.merge(rows((1, 1, 0.7, "v2"), (3, 1, 0.7, "v2"))) == ["2024-01"]
    got = {(r.asset_id, r.feature_date.month): (r.daily_return, r.feature_version) for r in table.current().collect()}
    assert got == {(1, 1): (0.7, "v2"), (2, 1): (0.5, "v1"), (3, 1): (0.7, "v2"), (1, 2): (0.5, "v1")}
    assert not glob.glob(f"{table.path}/.spark-staging*")


def test_ticks_are_shuffled_once(spark, tmp_path):
    """Bars and the windows over them share the one exchange of the ticks; a bar is the same sum however its ticks are dealt."""
    import datetime as dt

    from marketloom.operators.technical import technical_features
    from marketloom.sources import demo_universe as u
    day = dt.datetime(2000, 1, 3)
    rows = [(a, day + dt.timedelta(days=i // 2), 10.0 + i, float(1 + i % 3), "F") for a in (1, 2, None) for i in range(60)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double, l_linestatus string").repartition(
        5).write.parquet(f"{tmp_path}/lineitem.parquet")
    bars = u.bars(spark, str(tmp_path))
    plan = technical_features(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.asset_id, r.price_date): r for r in bars.collect()}
    assert len(got) == 90
    for i in range(0, 60, 2):
        r = got[2, (day + dt.timedelta(days=i // 2)).date()]
        prices = [(10.0 + k) / (1 + k % 3) for k in (i, i + 1)]
        assert (r.high_price, r.low_price, r.volume) == (max(prices), min(prices), 2 + i % 3 + (i + 1) % 3)
        assert r.close_price == (21.0 + 2 * i) / r.volume
