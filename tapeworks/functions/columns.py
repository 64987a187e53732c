"""Column functions of the trade tape: sides, prices, risk classes, periods, buckets, kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUY_YES, BUY_NO, SELL_YES, SELL_NO = 0, 1, 2, 3

# Word lists of the risk classes.
HEAD_TO_HEAD = r"(?i)\bvs\.?\b"
COMPETITIONS = r"(?i)\b(?:finals?|championship|cup|tournament|super bowl|world series|playoffs?)\b"
ACTIONS = r"(?i)\b(?:win|winner|champion|qualify|make|reach)\b"
LEAGUES = r"(?i)\b(?:nba|wnba|nfl|nhl|mlb|mls|ncaa|uefa|fifa|ufc|pga|atp|wta)\b"


def signed_shares(side: Column, size: Column) -> Column:
    """YES-equivalent shares: positive for BUY_YES and SELL_NO."""
    return F.when(side.isin(BUY_YES, SELL_NO), size).otherwise(-size)


def cashflow(side: Column, size: Column, yes_price: Column) -> Column:
    """YES-equivalent cash of the trade."""
    return -signed_shares(side, size) * yes_price


def token_price(side: Column, yes_price: Column) -> Column:
    """Price of the token that was traded, to four places."""
    return F.when(side.isin(BUY_YES, SELL_YES), yes_price).otherwise(F.round(1 - yes_price, 4))


def trade_direction(side: Column) -> Column:
    """Which outcome the trade bets on."""
    return F.when(side.isin(BUY_YES, SELL_NO), F.lit("YES")).otherwise(F.lit("NO"))


def price_for(direction: Column, yes_price: Column) -> Column:
    """Price of the direction's token at a YES price, to four places."""
    return F.when(direction == "YES", yes_price).otherwise(F.round(1 - yes_price, 4))


def risk_class(question: Column) -> Column:
    """competitive_event for games and winner-take-all competitions, else standard."""
    text = F.trim(question)
    game = F.rlike(text, F.lit(HEAD_TO_HEAD)) & ~F.endswith(text, F.lit("?"))
    contest = F.rlike(text, F.lit(ACTIONS)) & (F.rlike(text, F.lit(COMPETITIONS)) | F.rlike(text, F.lit(LEAGUES)))
    return F.when(game | contest, F.lit("competitive_event")).otherwise(F.lit("standard"))


def period_label(seconds: Column, grain: str) -> Column:
    """`2026`, `2026Q1` or `2026-01` of epoch seconds, in UTC."""
    ts = F.timestamp_seconds(seconds)
    if grain == "year":
        return F.year(ts).cast("string")
    if grain == "quarter":
        return F.concat(F.year(ts), F.lit("Q"), F.quarter(ts))
    if grain == "month":
        return F.concat(F.year(ts), F.lit("-"), F.lpad(F.month(ts).cast("string"), 2, "0"))
    raise ValueError(f"grain {grain!r} is not year, quarter or month")


def price_bucket(price: Column, stable_floor: float, lottery_low: float, lottery_high: float) -> Column:
    """stable above the floor, lottery inside the band, else null."""
    return F.when(price > stable_floor, F.lit("stable")).when(price.between(lottery_low, lottery_high), F.lit("lottery"))


def max_entry_price(confidence: Column, low: float, high: float, consensus: float, high_confidence: float, cap: float) -> Column:
    """Highest price to pay: a line from low at the consensus threshold to high at high_confidence, never above cap."""
    if high_confidence <= consensus:
        return F.lit(min(cap, low))
    share = (F.greatest(F.lit(consensus), F.least(F.lit(high_confidence), confidence)) - consensus) / (high_confidence - consensus)
    return F.least(F.lit(cap), low + share * (high - low))


def similarity_kernel(cosine: Column, threshold: float = 0.0, power: float = 1.0, normalize: bool = True) -> Column:
    """(max(cos - threshold, 0) / (1 - threshold)) ** power, of the cosine clipped to [0, 1]; not divided if normalize is false."""
    above = F.greatest(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)) - threshold, F.lit(0.0))
    return F.pow(above / (1 - threshold) if normalize else above, F.lit(power))
