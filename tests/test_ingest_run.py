import datetime as dt
import json

from pyspark.sql import functions as F

from marketloom.operators import upsert
from marketloom.plans import ingest_run
from marketloom.session import scratch_path
from marketloom.sources.lake import LakeTable
from marketloom.streaming import ingest

T0 = dt.datetime(2026, 3, 2, 18)
FEED = ingest_run.Provider("feed", "market_data", "https://feed.test")
RAW = "ticker string, date string, open double, high double, low double, close double, adj_close double, volume double, asset_id long"
META = ("ticker string, short_name string, long_name string, instrument_type string, quote_type string, exchange string, fast_exchange string, "
        "currency string, fast_currency string, sector string, industry string, country string, data_delayed_by int")


def bars(spark, *rows):
    """(ticker, date, close); an extra column clashes with the id that is looked up."""
    return spark.createDataFrame([(t, d, 1.0, 1.0, 1.0, c, None, 5.0, -7) for t, d, c in rows], RAW)


def metadata(spark, *tickers):
    return spark.createDataFrame([(t, f"Name {t}", None, "Equity", *[None] * 8, 0) for t in tickers], META)


def tables(spark, root):
    order = {"historical_prices": ingest_run.PRICE_ORDER, "market_data_ingestion_state": ingest_run.STATE_ORDER}
    return {n: LakeTable(spark, root, n, order.get(n, [])).current() for n in (
        "data_sources", "assets", "historical_prices", "rejected_rows", "ingestion_run_logs", "market_data_ingestion_state")}


def test_one_call_stores_rejects_and_logs(spark):
    root = scratch_path(spark, "t")
    raw = bars(spark, (" aaa ", "2026-01-02T00:00", 1.0), ("AAA", "2026-01-03", 2.0), ("AAA", "2026-01-03", 3.0), ("AAA", "2026-01-04", None),
               ("BBB", "2026-01-02", float("nan")), ("ZZZ", "2026-01-02", 1.0), (None, "2026-01-02", 1.0), ("", "2026-01-02", 1.0), ("AAA", "soon", 1.0))
    failures = spark.createDataFrame([("ccc", "rate_limited", "later")], "ticker string, fetch_status string, error_message string")
    got = ingest_run.ingest_market_batch(spark, root, raw, FEED, T0, metadata(spark, "aaa", "bbb"), failures)
    assert got == {"batch_id": 0, "source_id": 1, "rows": 9, "accepted": 3, "rejected": 6}
    t = tables(spark, root)
    assert {(r.ticker, r.asset_id, r.primary_source_id) for r in t["assets"].collect()} == {("AAA", 1, 1), ("BBB", 2, 1)}
    assert sorted((r.asset_id, str(r.price_date), float(r.close_price)) for r in t["historical_prices"].collect()) == [
        (1, "2026-01-02", 1.0), (1, "2026-01-03", 3.0)]
    rejected = t["rejected_rows"].collect()
    assert sorted((r.ticker or "", r.reason) for r in rejected) == sorted([
        ("AAA", "missing_close"), ("AAA", "missing_date"), ("BBB", "missing_close"), ("ZZZ", "unknown_asset"), ("", "missing_ticker"), ("", "missing_ticker")])
    assert json.loads(next(r.row_json for r in rejected if r.ticker == "ZZZ"))["close_price"] == 1.0
    log = {r.ticker: (r.fetch_status, r.record_count_fetched, r.records_written) for r in t["ingestion_run_logs"].collect()}
    assert log == {"AAA": ("success", 3, 3), "BBB": ("empty_response", 0, 0), "ZZZ": ("unknown_asset", 1, 0), "CCC": ("rate_limited", None, None)}
    state = {r.ticker: (r.fetch_status, r.last_successful_fetch_at, str(r.coverage_end_date)) for r in t["market_data_ingestion_state"].collect()}
    assert state["AAA"] == ("success", T0, "2026-01-03") and state["CCC"] == ("rate_limited", None, "None")


def test_second_batch_keeps_ids_and_last_success(spark):
    root = scratch_path(spark, "t")
    ingest_run.ingest_market_batch(spark, root, bars(spark, ("BBB", "2026-01-02", 1.0)), FEED, T0, metadata(spark, "bbb"))
    later = T0 + dt.timedelta(days=1)
    down = spark.createDataFrame([("bbb", "timeout", "slow")], "ticker string, fetch_status string, error_message string")
    for _ in range(2):  # a repeated batch replaces itself
        ingest_run.ingest_market_batch(spark, root, bars(spark, ("AAA", "2026-01-02", 1.0)), ingest_run.Provider("feed", "other"), later,
                                       metadata(spark, "aaa", "bbb"), down, batch_id=1)
    ingest_run.register_source(spark, root, ingest_run.Provider("another"), later, 2)
    t = tables(spark, root)
    assert {r.ticker: r.asset_id for r in t["assets"].collect()} == {"BBB": 1, "AAA": 2}
    assert {r.source_name: (r.source_id, r.source_type) for r in t["data_sources"].collect()} == {"feed": (1, "other"), "another": (2, "market_data")}
    assert {r.created_at for r in t["assets"].where("ticker = 'BBB'").collect()} == {T0}
    assert t["historical_prices"].count() == 2 and t["ingestion_run_logs"].count() == 3
    whole = {r.ticker: r for r in upsert.ingestion_state(t["ingestion_run_logs"]).collect()}
    for row in t["market_data_ingestion_state"].collect():
        assert row.asDict() == whole[row.ticker].asDict()
    assert whole["BBB"].fetch_status == "timeout" and whole["BBB"].last_successful_fetch_at == T0


def test_empty_batch(spark):
    root = scratch_path(spark, "t")
    got = ingest_run.ingest_market_batch(spark, root, bars(spark).where("false"), FEED, T0)
    assert (got["rows"], got["accepted"], got["rejected"]) == (0, 0, 0)
    counts = {n: LakeTable(spark, root, n).current().count() for n in ("historical_prices", "rejected_rows", "ingestion_run_logs")}
    assert set(counts.values()) == {0}


def test_news_batch(spark):
    root = scratch_path(spark, "t")
    ingest_run.ingest_market_batch(spark, root, bars(spark, ("AAA", "2026-01-02", 1.0)), FEED, T0, metadata(spark, "aaa"))
    good = json.dumps({"id": 1, "headline": "profit", "url": "https://n.test/1", "datetime": "1767225600"})
    raw = spark.createDataFrame([("aaa", "flat", good), ("AAA", "flat", json.dumps({"id": 2, "headline": "no url"})), ("zzz", "flat", good),
                                 ("aaa", "flat", None)], "ticker string, shape string, payload string")
    got = ingest_run.ingest_news_batch(spark, root, raw, ingest_run.Provider("desk", "news_api"), T0)
    assert (got["rows"], got["accepted"], got["rejected"], got["source_id"]) == (4, 1, 3, 2)
    row, = LakeTable(spark, root, "news_articles", ingest_run.NEWS_ORDER).current().collect()
    assert (row.asset_id, row.source_id, row.sentiment_label) == (1, 2, "positive")
    rejected = LakeTable(spark, root, "rejected_rows").current().where("table_name = 'news_articles'")
    assert {r.reason: r["count"] for r in rejected.groupBy("reason").count().collect()} == {"unusable_article": 2, "unknown_asset": 1}


def test_stream_of_raw_bars_is_logged(spark):
    """Two micro-batches: each is a batch of its own writer, with rejects, log and state."""
    root, landing = scratch_path(spark, "t"), scratch_path(spark, "landing")
    ingest_run.ingest_market_batch(spark, root, bars(spark, ("AAA", "2026-01-01", 1.0)), FEED, T0, metadata(spark, "aaa"))
    for day in ("2026-01-02", "2026-01-03"):
        bars(spark, ("AAA", day, 2.0), ("ZZZ", day, 1.0)).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(landing)
    ingest.ingest_raw_bars(stream, root, FEED, scratch_path(spark, "checkpoint")).awaitTermination()
    t = tables(spark, root)
    assert t["historical_prices"].count() == 3 and t["rejected_rows"].where(F.col("reason") == "unknown_asset").count() == 2
    assert t["ingestion_run_logs"].groupBy("ticker").count().where("ticker = 'ZZZ'").first()["count"] == 2
    assert {r.ticker: r.fetch_status for r in t["market_data_ingestion_state"].collect()} == {"AAA": "success", "ZZZ": "unknown_asset"}
