"""Universe-wide summaries: one briefing row and one signal row per asset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.columns import (
    clamp_probability, clamp_return, downside_regime, number_text, percent_text, ratio, return_outlook, tone_label)
from marketloom.operators.reads import newest_rows
from marketloom.operators.risk import annualize, risk_frame
from marketloom.operators.sentiment import sentiment_summary
from marketloom.sources.schemas import TRADING_DAYS


def asset_kpis(bars: DataFrame, price: str = "analysis_price", confidence_level: float = 0.95,
               volatility_window: int = 21, periods_per_year: int = TRADING_DAYS) -> DataFrame:
    """Coverage, returns, risk and drift inputs of every asset from one pass over its series."""
    rows = risk_frame(bars, price, confidence_level, volatility_window, periods_per_year)
    r, d, p = F.col("daily_return"), F.col("price_date"), F.col("price")
    growth = ratio(F.max_by(p, d), F.min_by(p, d))
    years = ratio(F.lit(float(periods_per_year)), F.count("*") - 1)
    enough = F.count("*") >= 2
    return rows.groupBy("asset_id").agg(
        F.min(d).alias("coverage_start"), F.max(d).alias("coverage_end"), F.count("*").alias("observation_count"),
        F.max_by(p, d).alias("latest_price"),
        F.when(enough, growth - 1.0).alias("total_return"),
        F.when(enough & (growth > 0), F.pow(growth, years) - 1.0).alias("annualized_return"),
        annualize(F.stddev_samp(r), periods_per_year).alias("annualized_volatility"),
        F.min("drawdown").alias("max_drawdown"), (-F.max("cutoff")).alias("historical_var"),
        (-F.avg(F.when(r <= F.col("cutoff"), r))).alias("expected_shortfall"),
        F.max_by("rolling_volatility", F.when(F.col("rolling_volatility").isNotNull(), d)).alias("latest_rolling_volatility"),
        F.avg(r).alias("daily_drift"), F.stddev_samp(r).alias("daily_volatility"), F.count(r).alias("observations"))


def briefing_mart(kpis: DataFrame, assets: DataFrame, articles: DataFrame | None = None,
                  predictions: DataFrame | None = None, news_limit: int = 25) -> DataFrame:
    """One row per asset with price history. Every input is reduced to one row per asset before it is joined."""
    mart = kpis.join(assets.select("asset_id", "ticker", "asset_name", "asset_class"), "asset_id")
    if articles is not None:
        newest = newest_rows(articles, news_limit, ["asset_id"], [F.desc("published_at"), F.asc("url")])
        mart = mart.join(sentiment_summary(newest), "asset_id", "left")
        mart = mart.withColumns({c: F.coalesce(c, F.lit(0)) for c in (
            "article_count", "positive_count", "negative_count", "neutral_count")})
    if predictions is not None:
        mart = mart.join(predictions.select(
            "asset_id", "as_of_date", "prediction_horizon_days", "predicted_return_20d", "probability_positive_20d",
            "composite_ml_score", "confidence_score", "directional_signal", "history_score", "risk_score",
            "sentiment_score"), "asset_id", "left")
    return mart


def _sentence(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _has(frame: DataFrame, column: str) -> bool:
    return column in frame.columns


def commentary(mart: DataFrame) -> DataFrame:
    """Templated text columns. Wording is our own; the figures are those of the mart."""
    c = F.col
    total, yearly = percent_text(c("total_return")), percent_text(c("annualized_return"))
    vol, fall = percent_text(c("annualized_volatility")), percent_text(c("max_drawdown"))
    var, es = percent_text(c("historical_var")), percent_text(c("expected_shortfall"))
    out = {
        "executive_text": _sentence(
            F.coalesce("asset_name", "ticker"), " (", F.lower(F.coalesce("asset_class", F.lit("asset"))), ") returned ",
            total, " over the stored history, ", yearly, " a year, at an annualized volatility of ", vol,
            ". Deepest drawdown: ", fall, "; one-day 95% VaR: ", var, "."),
        "performance_text": _sentence(
            "Performance was ", F.when(c("total_return") >= 0, "positive").otherwise("negative"),
            ": total return ", total, ", annualized ", yearly, "."),
        "risk_text": _sentence("Volatility ", vol, ", drawdown ", fall, ", 95% VaR ", var,
                               ", expected shortfall ", es, ". Past figures, not a forecast."),
    }
    if _has(mart, "article_count"):
        out["sentiment_text"] = F.when(c("article_count") == 0, "No stored news.").otherwise(_sentence(
            c("article_count").cast("string"), " recent articles, tone ", tone_label(c("average_sentiment")),
            ", mean score ", number_text(c("average_sentiment")), "; positive ", c("positive_count").cast("string"),
            ", neutral ", c("neutral_count").cast("string"), ", negative ", c("negative_count").cast("string"), "."))
    if _has(mart, "composite_ml_score"):
        out["signal_text"] = F.when(c("composite_ml_score").isNull(), "No stored model signal.").otherwise(_sentence(
            "Composite score ", number_text(c("composite_ml_score")), " (", F.lower("directional_signal"), "). Expected ",
            c("prediction_horizon_days").cast("string"), "-day return ", percent_text(c("predicted_return_20d")),
            ", chance of a gain ", percent_text(c("probability_positive_20d")), ". Pillars: history ",
            number_text(c("history_score")), ", risk ", number_text(c("risk_score")), ", sentiment ",
            number_text(c("sentiment_score")), "."))
    return mart.withColumns(out)


# Reasons shown when a part of a stored signal is missing.
_MISSING = {
    "history_score": "history pillar missing in the stored signal",
    "risk_score": "risk pillar missing in the stored signal",
    "sentiment_score": "sentiment pillar missing in the stored signal",
}
NEUTRAL_SENTIMENT = "no news behind the sentiment pillar; neutral values were used"


def signal_summary(latest: DataFrame) -> DataFrame:
    """Latest stored signal per asset, clamped, with labels, reasons for missing parts and a sentence."""
    c = F.col
    no_news = (F.coalesce("article_count_7d", F.lit(0)) == 0) & (F.coalesce("source_count_7d", F.lit(0)) == 0)
    reasons = {f"{n}_reason": F.when(c(n).isNull(), text) for n, text in _MISSING.items()}
    reasons["sentiment_score_reason"] = F.when(c("sentiment_score").isNull(), _MISSING["sentiment_score"]).when(
        no_news, NEUTRAL_SENTIMENT)
    base = latest.withColumns({
        "predicted_return_20d": clamp_return(c("predicted_return_20d")),
        **{n: clamp_probability(c(n)) for n in
           ("downside_probability_20d", "probability_positive_20d", "confidence_score")},
        "directional_signal": F.coalesce("directional_signal", F.lit("Neutral")),
        "model_name": F.coalesce("selected_model_name", "regression_model_name", F.lit("ridge_regression")),
        **reasons,
        **{f"{n}_contribution": F.coalesce(f"{n}_contribution", F.lit(0.0)) for n in ("history", "risk", "sentiment")},
    })
    up, down, ret = c("probability_positive_20d"), c("downside_probability_20d"), c("predicted_return_20d")
    notes = F.array_compact(F.array(*[c(n) for n in reasons]))
    text = F.concat_ws(
        " ",
        F.when(c("composite_ml_score").isNull(), "Composite score unavailable.").otherwise(
            _sentence("Composite score ", number_text(c("composite_ml_score"), 1), ", signal ",
                      F.lower("directional_signal"), ".")),
        F.when(ret.isNull() | up.isNull(), "Return or probability unavailable.").otherwise(
            _sentence("Expected 20-day return ", percent_text(ret), ", chance of a gain ", percent_text(up), ".")),
        F.when(c("confidence_score").isNull(), "Confidence unavailable.").otherwise(
            _sentence("Confidence ", percent_text(c("confidence_score"), 0), ".")),
        F.when(down.isNotNull(), _sentence("Chance of a loss ", percent_text(down), ": ",
                                           F.lower(downside_regime(down)), ".")),
        F.when(F.size(notes) > 0, _sentence("Notes: ", F.array_join(notes, "; "), ".")))
    return base.withColumns({
        "return_outlook": return_outlook(ret), "downside_regime": downside_regime(down),
        "partial_inputs": notes, "interpretation": text})


# Schemas of the lists that a prediction stores as JSON.
EXPLANATIONS = {
    "pillar_weights_json": "array<struct<pillar:string,weight:double>>",
    "feature_importance_json": "array<struct<feature:string,importance:double>>",
    "top_features_json": "array<struct<feature:string,standardized_value:double,coefficient:double,contribution:double,"
                         "absolute_contribution:double>>",
}
NO_SIGNAL = "No stored model signal for this asset."
_INCOMPLETE = {"composite_ml_score": "composite score missing: the scoring was incomplete",
               "confidence_score": "confidence missing: the scoring was incomplete"}


def parsed_explanations(stored: DataFrame) -> DataFrame:
    """Adds each stored JSON list as an array; a missing or unreadable list is empty."""
    return stored.withColumns({n.removesuffix("_json"): F.coalesce(F.from_json(n, s), F.array().cast(s))
                               for n, s in EXPLANATIONS.items() if n in stored.columns})


def signal_overview(latest: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per asset, also without a stored signal: the summary, every reason, the pillars in words and the parsed lists."""
    c = F.col
    pillars = [c(f"{n}_score") for n in ("history", "risk", "sentiment")]
    known = pillars[0].isNotNull() & pillars[1].isNotNull() & pillars[2].isNotNull()
    base = signal_summary(parsed_explanations(latest)).drop("ticker")
    base = base.withColumns({
        **{f"{n}_reason": F.when(c(n).isNull(), text) for n, text in _INCOMPLETE.items()},
        "pillar_text": F.when(known, _sentence(
            "Pillars: history ", number_text(pillars[0]), ", risk ", number_text(pillars[1]), ", sentiment ", number_text(pillars[2]), "."))
        .otherwise("Pillar scores are incomplete, see the notes.")})
    rows = assets.select("asset_id", "ticker").join(base, "asset_id", "left")
    available = c("as_of_date").isNotNull()
    return rows.withColumns({
        "available": available,
        "regime_label": c("directional_signal"),
        "interpretation": F.when(available, F.concat_ws(" ", "interpretation", "pillar_text")).otherwise(NO_SIGNAL)})


def pillar_contribution_rows(summary: DataFrame) -> DataFrame:
    """Chart rows: one per asset and pillar."""
    structs = F.array(*[F.struct(F.lit(p.title()).alias("pillar"), F.col(f"{p}_contribution").alias("contribution"))
                        for p in ("history", "risk", "sentiment")])
    return summary.select("asset_id", F.explode(structs).alias("x")).select("asset_id", "x.*")
