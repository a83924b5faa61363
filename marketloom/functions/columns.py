"""Column expressions used by the jobs of this package."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: finance lexicon
POSITIVE_TERMS = [
    "beat", "beats", "bullish", "gain", "gains", "growth", "improve", "improves", "improved", "optimistic",
    "outperform", "outperforms", "profit", "profits", "record", "resilient", "rise", "rises", "strong", "surge",
    "surges", "upgrade", "upgrades",
]
NEGATIVE_TERMS = [
    "bearish", "cut", "cuts", "decline", "declines", "declined", "downgrade", "downgrades", "drop", "drops", "fall",
    "falls", "fraud", "loss", "losses", "miss", "misses", "probe", "risk", "risks", "selloff", "slump", "weak",
]
STRIPPED_CHARACTERS = ".,:;!?()[]{}\"'"

# fixed values: thresholds
LABEL_THRESHOLD = 0.2
SIGNAL_THRESHOLD = 20.0
HARD_RETURN_CAP = 0.60


def ratio(numerator, denominator) -> Column:
    """Division that is NULL, not an error, for a zero denominator."""
    return F.try_divide(numerator, denominator)


def finite(column: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(column) & (F.abs(column) != F.lit(float("inf"))), column)


def ticker_code(raw: Column) -> Column:
    """Trimmed, upper-cased ticker without inner blanks; dashes unified, ``A/B`` becomes ``A-B``."""
    text = F.translate(F.upper(raw), "–—−", "---")
    text = F.regexp_replace(text, r"(?U)\s+", "")
    return F.regexp_replace(text, r"(?U)(?<=\w)/(?=\w)", "-")


def blank_to_null(raw: Column) -> Column:
    """Missing-value spellings of provider feeds become NULL, other text is trimmed."""
    return F.when(~raw.isin("", "None", "nan"), F.trim(raw))


def lexical_score(text: Column, positive: Iterable[str] = POSITIVE_TERMS,
                  negative: Iterable[str] = NEGATIVE_TERMS) -> Column:
    """(pos - neg) / (pos + neg) over the words of the whole text; 0 when no word is in the lexicon."""
    positive, negative = list(positive), list(negative)
    words = F.transform(
        F.split(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+"),
        lambda w: F.lower(F.btrim(w, F.lit(STRIPPED_CHARACTERS))),
    )
    known = F.filter(words, lambda w: w.isin(positive + negative))
    balance = F.aggregate(
        known,
        F.struct(F.lit(0).alias("net"), F.lit(0).alias("n")),
        lambda acc, w: F.struct(
            (acc["net"] + F.when(w.isin(positive), 1).otherwise(0)
             - F.when(w.isin(negative), 1).otherwise(0)).alias("net"),
            (acc["n"] + F.when(w.isin(positive), 1).otherwise(0)
             + F.when(w.isin(negative), 1).otherwise(0)).alias("n"),
        ),
        lambda acc: F.coalesce(F.bround(F.try_divide(acc["net"].cast("double"), acc["n"]), 4), F.lit(0.0)),
    )
    return balance


def sentiment_label(score: Column) -> Column:
    return (F.when(score >= LABEL_THRESHOLD, "positive")
            .when(score <= -LABEL_THRESHOLD, "negative")
            .when(score.isNotNull(), "neutral"))


def published_time(raw: Column) -> Column:
    """Epoch seconds, epoch milliseconds (above 1e10) or ISO text with or without a zone, as UTC."""
    number = F.when(raw.rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$"), raw.try_cast("double"))
    seconds = F.when(number > 1e10, number / 1000.0).otherwise(number)
    micros = F.round(seconds * 1e6).cast("long")
    return F.when(number.isNotNull(), F.timestamp_micros(micros)).otherwise(raw.try_cast("timestamp"))


def iso_text(ts: Column) -> Column:
    """ISO-8601 text; fraction digits only when there is a fraction."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def fallback_article_id(url: Column, headline: Column, published_at: Column) -> Column:
    key = F.concat_ws("|", F.coalesce(url, F.lit("")), headline, iso_text(published_at))
    return F.substring(F.sha2(key, 256), 1, 24)


def news_query_text(ticker: Column, name: Column) -> Column:
    def quoted(c):
        return F.when(F.length(F.trim(c)) > 0, F.concat(F.lit('"'), F.trim(c), F.lit('"')))
    return F.concat_ws(" OR ", quoted(F.upper(ticker)), quoted(name))


def clamp_probability(p: Column) -> Column:
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def volatility_floor(scale: Column) -> Column:
    return F.greatest(scale, F.lit(0.02))


def clamp_return(r: Column, scale: Column | None = None, hard_cap: float = HARD_RETURN_CAP) -> Column:
    cap = F.lit(hard_cap)
    if scale is not None:
        dynamic = F.least(F.greatest(4.0 * volatility_floor(scale), F.lit(0.20)), F.lit(hard_cap))
        cap = F.when(scale.isNull(), F.lit(hard_cap)).otherwise(dynamic)
    return F.when(r.isNotNull(), F.least(F.greatest(r, -cap), cap))


def mean_of_present(*columns: Column) -> Column:
    """Mean over the non-NULL arguments."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    present = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in columns])
    return ratio(total, present)


def composite_score(predicted: Column, p_up: Column, pillars: list[Column], scale: Column) -> Column:
    signal = F.tanh(clamp_return(predicted, scale) / volatility_floor(scale))
    direction = 2.0 * clamp_probability(p_up) - 1.0
    return 100.0 * (0.45 * signal + 0.35 * direction + 0.20 * mean_of_present(*pillars))


def confidence(predicted: Column, challenger: Column, p_up: Column, scale: Column) -> Column:
    one = F.lit(1.0)
    sigma = volatility_floor(scale)
    r, c, p = clamp_return(predicted, scale), clamp_return(challenger, scale), clamp_probability(p_up)
    strength = F.least(F.abs(r) / sigma, one)
    conviction = F.least(F.abs(2.0 * p - 1.0), one)
    agreement = 1.0 - F.least(F.abs(r - c) / sigma, one)
    implied_up = 1.0 / (1.0 + F.exp(-(r / sigma)))
    alignment = 1.0 - F.least(F.abs(implied_up - p), one)
    blend = 0.30 * strength + 0.20 * conviction + 0.25 * agreement + 0.25 * alignment
    known = r.isNotNull() & c.isNotNull() & p.isNotNull()
    return F.when(known, clamp_probability(blend))


def signal_label(score: Column) -> Column:
    return (F.when(score >= SIGNAL_THRESHOLD, "Favorable")
            .when(score <= -SIGNAL_THRESHOLD, "Unfavorable").otherwise("Neutral"))


def return_outlook(r: Column) -> Column:
    return (F.when(r.isNull(), "Unavailable").when(r >= 0.03, "Constructive")
            .when(r <= -0.03, "Defensive").otherwise("Balanced"))


def downside_regime(p: Column) -> Column:
    return (F.when(p.isNull(), "Unavailable").when(p >= 0.60, "Elevated downside risk")
            .when(p <= 0.40, "Contained downside risk").otherwise("Mixed downside risk"))


def tone_label(score: Column) -> Column:
    return (F.when(score >= LABEL_THRESHOLD, "constructive")
            .when(score <= -LABEL_THRESHOLD, "cautious").otherwise("mixed"))


def percent_text(x: Column, digits: int = 2) -> Column:
    shown = F.format_string(f"%.{digits}f%%", 100.0 * x)
    return F.when(x.isNull(), "N/A").otherwise(shown)


def number_text(x: Column, digits: int = 2) -> Column:
    shown = F.format_string(f"%,.{digits}f", x.cast("double"))
    return F.when(x.isNull(), "N/A").otherwise(shown)
