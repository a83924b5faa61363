import datetime as dt
import json
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from marketloom.functions import columns as fc
from marketloom.sources import normalize


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


@pytest.mark.parametrize("raw,want", [("  brk/b ", "BRK-B"), (" msft ", "MSFT"), ("btc-usd", "BTC-USD"), ("a–b", "A-B"), ("", "")])
def test_ticker_codes(spark, raw, want):
    assert one(spark, fc.ticker_code(F.col("v")), raw) == want


@pytest.mark.parametrize("text,sign", [
    ("Company beats expectations with strong growth", 1), ("Analysts warn of weak demand and losses", -1),
    ("Company announces conference schedule", 0), ("", 0), (None, 0)])
def test_lexical_sign(spark, text, sign):
    score = one(spark, fc.lexical_score(F.col("v")), text)
    assert (score > 0) - (score < 0) == sign


def test_lexical_score_reads_the_whole_text(spark):
    text = "filler " * 50_000 + "profit, (loss)! profit."
    assert one(spark, fc.lexical_score(F.col("v")), text) == pytest.approx(0.3333)


def test_lexical_score_rounds_half_even(spark):
    words = "gain " * 33 + "loss " * 31  # 2 / 64 = 0.03125
    assert one(spark, fc.lexical_score(F.col("v")), words) == 0.0312


@pytest.mark.parametrize("score,label", [(0.2, "positive"), (-0.2, "negative"), (0.19, "neutral")])
def test_labels(spark, score, label):
    assert one(spark, fc.sentiment_label(F.col("v")), score, "double") == label


@pytest.mark.parametrize("raw", ["1704067200", "1704067200000", "2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00"])
def test_publication_time(spark, raw):
    assert one(spark, fc.published_time(F.col("v")), raw) == dt.datetime(2024, 1, 1)


def test_unreadable_time_is_null(spark):
    assert one(spark, fc.published_time(F.col("v")), "yesterday") is None


@pytest.mark.parametrize("r,s,want", [(-19.3097, 0.05, -0.20), (3.2, 0.20, 0.60), (3.2, None, 0.60), (None, 0.1, None)])
def test_clamped_returns(spark, r, s, want):
    got = spark.createDataFrame([(r, s)], "r double, s double").select(fc.clamp_return(F.col("r"), F.col("s"))).first()[0]
    assert got == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("p,want", [(1.4, 1.0), (-0.3, 0.0), (None, None)])
def test_clamped_probabilities(spark, p, want):
    assert one(spark, fc.clamp_probability(F.col("v")), p, "double") == want


def test_scores_and_labels(spark):
    row = spark.createDataFrame([(0.05, 0.04, 0.7, 0.5, None, -0.1)], "r double, c double, p double, h double, k double, s double").select(
        fc.composite_score(F.col("r"), F.col("p"), [F.col("h"), F.col("k"), F.col("s")], F.lit(0.1)).alias("score"),
        fc.confidence(F.col("r"), F.col("c"), F.col("p"), F.lit(0.1)).alias("conf"),
        fc.signal_label(F.lit(20.0)).alias("label")).first()
    import math
    assert row.score == pytest.approx(100 * (0.45 * math.tanh(0.5) + 0.35 * 0.4 + 0.20 * 0.2))
    up = 1 / (1 + math.exp(-0.5))
    assert row.conf == pytest.approx(0.3 * 0.5 + 0.2 * 0.4 + 0.25 * 0.9 + 0.25 * (1 - abs(up - 0.7)))
    assert row.label == "Favorable"


def test_formats(spark):
    assert one(spark, fc.percent_text(F.col("v")), 0.1234, "double") == "12.34%"
    assert one(spark, fc.number_text(F.col("v")), 1234.5, "double") == "1,234.50"
    assert one(spark, fc.number_text(F.col("v")), None, "double") == "N/A"


def test_query_text(spark):
    df = spark.createDataFrame([("aapl", "Apple Inc"), ("x", " ")], "t string, n string")
    assert [r[0] for r in df.select(fc.news_query_text(F.col("t"), F.col("n"))).collect()] == ['"AAPL" OR "Apple Inc"', '"X"']


def test_feed_shapes(spark):
    rows = [
        ("flat", {"id": 7, "headline": " Profit rises ", "summary": "", "snippet": "s", "url": "u1", "datetime": 1704067200, "source": "Desk"}),
        ("nested", {"id": "x", "title": "Losses", "content": "weak", "url": "u2", "publishedAt": "2024-01-01T00:00:00Z", "source": {"name": "P"}}),
        ("nested_without_id", {"title": "T", "description": None, "url": "u3", "publishedAt": "2024-01-01T00:00:00Z", "source": {"name": None}}),
        ("nested", {"title": "no url", "publishedAt": "2024-01-01T00:00:00Z"}),
        ("flat", {"headline": "no time", "url": "u"})]
    raw = spark.createDataFrame([(s, json.dumps(p)) for s, p in rows], "shape string, payload string")
    got = {r.url: r for r in normalize.normalize_feeds(raw).collect()}
    assert set(got) == {"u1", "u2", "u3"}
    assert got["u1"].headline == "Profit rises" and got["u1"].summary == "s" and got["u1"].provider_article_id == "7"
    assert got["u2"].sentiment_label == "negative" and got["u2"].publisher_name == "P"
    assert got["u3"].provider_article_id == sha256(b"u3|T|2024-01-01T00:00:00").hexdigest()[:24]


def test_normalized_bars(spark):
    nan = float("nan")
    raw = spark.createDataFrame(
        [("2026-03-20T00:00:00-04:00", 1.0, 2.0, 0.5, 1.23456789, None, 10.0), ("2026-03-21", 1.0, 1.0, 1.0, nan, 1.0, nan)],
        "date string, open double, high double, low double, close double, adj_close double, volume double")
    rows = normalize.normalize_bars(raw).collect()
    assert len(rows) == 1 and str(rows[0].close_price) == "1.234568" and rows[0].price_date == dt.date(2026, 3, 20)
    assert rows[0].adjusted_close is None and rows[0].volume == 10
