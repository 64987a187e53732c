"""Summaries of positions, fills and equity, by case and period."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import period_label
from tapeworks.operators.quantiles import exact_percentiles, ranked_values
from tapeworks.operators.small import few


def position_metrics(positions: DataFrame) -> DataFrame:
    """(case, trades, pnl, win_rate, roi, pnl_std) of settled positions; the deviation is that of a sample, 0 for one."""
    return positions.where("pnl is not null").groupBy("case").agg(
        F.count("*").alias("trades"),
        F.sum("pnl").alias("pnl"),
        (F.count_if(F.col("pnl") > 0) / F.count("*")).alias("win_rate"),
        (F.sum("pnl") / F.sum("notional")).alias("roi"),
        F.coalesce(F.stddev_samp("pnl"), F.lit(0.0)).alias("pnl_std"),
    )


def case_summary(fills: DataFrame, positions: DataFrame, equity: DataFrame, initial: float) -> DataFrame:
    """One row a case: counts, profit factor, returns, expected shortfall of the worst 5 %, fees, net result, drawdown.

    The median and the tail's border are found by selection (`quantiles`), so a case of very many positions is not sorted in one task.
    """
    settled = positions.where("pnl is not null").withColumn("ret", F.col("pnl") / F.col("notional"))
    by_case = settled.groupBy("case").agg(
        F.count("*").alias("closed_positions"),
        (F.count_if(F.col("pnl") > 0) / F.count("*")).alias("win_rate"),
        F.count_if(F.col("pnl") < 0).alias("losses"),
        F.sum("pnl").alias("gross_pnl"),
        F.coalesce(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(-F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))), F.lit(0.0)).alias("gross_loss"),
        F.avg("ret").alias("mean_return"),
        F.min("pnl").alias("worst_pnl"),
        F.min("ret").alias("worst_return"),
        F.max("notional").alias("largest_notional"),
    )
    tail = F.ceil(F.col("n") * 0.05)
    border = ranked_values(settled, ["case"], "pnl", {"border": lambda n: F.ceil(n * 0.05) - 1}).withColumn("tail", tail)
    under = settled.join(border, "case").groupBy("case", "tail", "border").agg(F.coalesce(F.sum(F.when(F.col("pnl") < F.col("border"), F.col("pnl"))), F.lit(0.0)).alias("s"), F.count_if(F.col("pnl") < F.col("border")).alias("k"))
    shortfall = under.select("case", ((F.col("s") + (F.col("tail") - F.col("k")) * F.col("border")) / F.col("tail")).alias("expected_shortfall"))
    by_case = by_case.join(exact_percentiles(settled, ["case"], "ret", {"median_return": 0.5}), "case", "left").join(shortfall, "case", "left")
    paid = fills.groupBy("case").agg(F.count("*").alias("fills"), F.sum("fee").alias("fees"))
    last = equity.groupBy("case").agg(F.max_by("equity", "day").alias("final_equity"))
    out = paid.join(by_case, "case", "left").join(last, "case", "left").join(drawdown(equity).groupBy("case").agg(F.min("drawdown").alias("max_drawdown")), "case", "left")
    return out.withColumns({"profit_factor": F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")), "net_pnl": F.col("gross_pnl") - F.col("fees"), "total_return": F.col("final_equity") / initial - 1})


def drawdown(equity: DataFrame, initial: float | None = None) -> DataFrame:
    """(case, day, equity, peak, drawdown): against the highest equity so far, and the initial balance if one is given."""
    peak = F.max("equity").over(Window.partitionBy("case").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    if initial is not None:
        peak = F.greatest(peak, F.lit(initial))
    return equity.select("case", "day", "equity", peak.alias("peak"), (F.col("equity") / peak - 1).alias("drawdown"))


def poisson_steps(n: int = 7) -> list[float]:
    """The probabilities that a Poisson(1) number is at most 0, 1, ... n - 1."""
    out, total, term = [], 0.0, math.exp(-1)
    for k in range(1, n + 1):
        total += term
        out.append(total)
        term /= k
    return out


def bootstrap_ci(positions: DataFrame, draws: int = 200, seed: int = 7) -> DataFrame:
    """(case, n, low, high): 95 % interval of the mean return, null for fewer than two positions.

    Each draw weights every position by a Poisson(1) number that depends on seed, draw, case and
    market only (by MD5, so that any engine can repeat it), so positions are never gathered; draws
    are rows of one aggregation.
    """
    rets = positions.where("pnl is not null and notional > 0").select("case", "market_id", (F.col("pnl") / F.col("notional")).alias("ret"))
    rows = rets.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), "case", F.col("market_id").cast("string")))
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)
    weight = reduce(lambda a, x: a + (F.col("u") > x).cast("int"), poisson_steps(), F.lit(0))
    drawn = rows.withColumn("u", u).withColumn("w", weight).groupBy("case", "draw").agg(F.sum(F.col("w") * F.col("ret")).alias("s"), F.sum("w").alias("w"))
    means = drawn.where("w > 0").select("case", (F.col("s") / F.col("w")).alias("mean"))
    interval = means.groupBy("case").agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    out = rets.groupBy("case").agg(F.count("*").alias("n")).join(interval, "case", "left")
    return out.select("case", "n", *[F.when(F.col("n") >= 2, F.col(c)).alias(c) for c in ("low", "high")])


def period_results(fills: DataFrame, positions: DataFrame, equity: DataFrame, initial: float) -> DataFrame:
    """(case, grain, period, ...) for years, quarters and months at once: equity from the period before, return, closed positions, wins, pnl, fees, worst."""

    def labelled(df: DataFrame, seconds: str, *columns) -> DataFrame:
        t = F.col(seconds)
        labels = {f"p_{g}": period_label(t, g) for g in ("year", "quarter", "month")}
        return df.withColumns(labels).select("case", *labels, *columns)

    ends = labelled(equity.withColumn("t", F.col("day") * 86400), "t", "day", "equity")
    closed = labelled(positions.where("pnl is not null"), "resolved_at", "pnl", "notional")
    paid = labelled(fills, "filled_at", "fee")
    sets = [["case", "p_year"], ["case", "p_quarter"], ["case", "p_month"]]
    columns = ["case", "p_year", "p_quarter", "p_month"]

    def grouped(df: DataFrame, *aggs) -> DataFrame:
        out = df.groupingSets(sets, *columns).agg(*aggs)
        grain = F.when(F.col("p_year").isNotNull(), "year").when(F.col("p_quarter").isNotNull(), "quarter").otherwise("month")
        return out.withColumns({"grain": grain, "period": F.coalesce("p_year", "p_quarter", "p_month")}).drop(*columns[1:])

    e = grouped(ends, F.max_by("equity", "day").alias("end_equity"))
    before = F.coalesce(F.lag("end_equity").over(Window.partitionBy("case", "grain").orderBy("period")), F.lit(initial))
    e = e.withColumn("start_equity", before)
    c = grouped(closed, F.count("*").alias("closed"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("pnl"), F.sum("notional").alias("closed_notional"), F.min("pnl").alias("worst"))
    f = grouped(paid, F.sum("fee").alias("fees"))
    key = ["case", "grain", "period"]
    out = e.join(c, key, "left").join(f, key, "left").fillna(0, ["closed", "wins", "pnl", "closed_notional", "fees", "worst"])
    return out.select(*key, "start_equity", "end_equity", (F.col("end_equity") / F.col("start_equity") - 1).alias("period_return"), "closed", "wins", F.when(F.col("closed") > 0, F.col("wins") / F.col("closed")).alias("win_rate"), "pnl", "fees", (F.col("pnl") - F.col("fees")).alias("net_pnl"), "closed_notional", "worst")


def execution_diagnostics(orders: DataFrame, fills: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """One row a case: how many orders were filled in full, in part or not, and quantiles of children, seconds, participation and price drift."""
    per_order = fills.groupBy("case", "market_id").agg(F.sum("notional").alias("filled"), F.count("*").alias("children"), (F.max("filled_at") - F.min("signal_time")).alias("seconds"))
    o = orders.select("case", "market_id", "stake").join(per_order, ["case", "market_id"], "left").fillna(0.0, ["filled"])
    some, full = F.col("filled") > tolerance, F.col("filled") >= F.col("stake") - tolerance
    counts = o.groupBy("case").agg(
        F.count("*").alias("orders"),
        F.count_if(some).alias("with_fill"),
        F.count_if(full).alias("full"),
        F.count_if(some & ~full).alias("partial"),
        F.count_if(~some).alias("unfilled"),
        F.sum("stake").alias("requested"),
        F.sum("filled").alias("filled"),
    )
    each = fills.select("case", (F.col("quantity") / F.col("source_size")).alias("participation"), (10000 * (F.col("fill_price") / F.col("signal_price") - 1)).alias("drift"))
    parts = [
        exact_percentiles(o, ["case"], "children", {"median_children": 0.5}),
        exact_percentiles(o, ["case"], "seconds", {"median_seconds": 0.5, "p90_seconds": 0.9}),
        exact_percentiles(each, ["case"], "participation", {"median_participation": 0.5, "p90_participation": 0.9}),
        exact_percentiles(each, ["case"], "drift", {"median_drift_bps": 0.5, "p90_drift_bps": 0.9}),
    ]
    out = reduce(lambda x, y: x.join(y, "case", "left"), parts, counts)
    return out.withColumn("fill_ratio", F.when(F.col("requested") > 0, F.col("filled") / F.col("requested")))


def bucket_win_rates(positions: DataFrame, orders: DataFrame) -> DataFrame:
    """(case, bucket, closed, wins, win_rate) of settled positions."""
    rows = positions.where("pnl is not null").join(orders.select("case", "market_id", "bucket"), ["case", "market_id"])
    return rows.groupBy("case", "bucket").agg(F.count("*").alias("closed"), F.count_if(F.col("pnl") > 0).alias("wins"), (F.count_if(F.col("pnl") > 0) / F.count("*")).alias("win_rate"))


def pnl_tail(positions: DataFrame, k: int) -> DataFrame:
    """(case, rank, market_id, pnl, winners, losers): the k worst settled positions of each case.

    Ranks stand alone in their window, so that a task keeps k rows of a case before the shuffle; the counts are an aggregation of their own.
    """
    rows = positions.where("pnl is not null").select("case", "market_id", "pnl")
    worst = rows.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy("pnl", "market_id"))).where(F.col("rank") <= k)
    counts = rows.groupBy("case").agg(F.count_if(F.col("pnl") > 0).alias("winners"), F.count_if(F.col("pnl") < 0).alias("losers"))
    return worst.join(counts, "case").select("case", "rank", "market_id", "pnl", "winners", "losers")


def support_stats(fills: DataFrame, orders: DataFrame, signals: DataFrame, positions: DataFrame, markets: DataFrame, top: int) -> DataFrame:
    """(case, fills, markets, mean_history, mean_wallets, events, in_top): support of the signals behind fills, by their order's print.

    markets: market_id, rank, events (array of ids). events counts the distinct ones of settled positions, in_top those positions whose market is among the largest.
    """
    s = orders.select("case", "market_id", "seq").join(signals.select("market_id", "seq", "mean_history_markets", "directional_wallets"), ["market_id", "seq"]).drop("seq")
    of_fills = fills.select("case", "market_id").join(s, ["case", "market_id"], "left").groupBy("case").agg(F.count("*").alias("fills"), F.countDistinct("market_id").alias("markets"), F.avg("mean_history_markets").alias("mean_history"), F.avg("directional_wallets").alias("mean_wallets"))
    held = positions.where("pnl is not null").select("case", "market_id").join(markets.select("market_id", "rank", "events"), "market_id", "left")
    events = held.select("case", F.explode("events").alias("event")).groupBy("case").agg(F.countDistinct("event").alias("events"))
    ranked = held.groupBy("case").agg(F.count_if(F.col("rank") <= top).alias("in_top"))
    return of_fills.join(events, "case", "left").join(ranked, "case", "left").fillna(0, ["events", "in_top"])


def equity_daily(curve: DataFrame, fills: DataFrame | None = None, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """(case, day, equity): the last state of each UTC day of a curve (case, ts, equity and the columns of order), in that order; from the day of the first fill, if fills are given."""
    out = curve.groupBy("case", F.floor(F.col("ts") / 86400).alias("day")).agg(F.max_by("equity", F.struct(*order)).alias("equity"))
    if fills is not None:
        first = fills.groupBy("case").agg(F.floor(F.min("filled_at") / 86400).alias("first"))
        out = out.join(first, "case").where("day >= first").drop("first")
    return out


def sensitivity_table(summaries: DataFrame, grid: DataFrame) -> DataFrame:
    """(parameter, value, is_primary, return_pct, drawdown_pct, profit_factor) for grid rows (case, parameter, value, is_primary)."""
    rows = summaries.join(few(grid), "case")
    return rows.select("parameter", "value", "is_primary", (100 * F.col("total_return")).alias("return_pct"), (100 * F.col("max_drawdown")).alias("drawdown_pct"), "profit_factor")


def activation_counts(activations: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule, markets, fractional): markets activated per rule, and how many of them pay a fraction."""
    rows = activations.join(labels.select("market_id", "payout_yes"), "market_id", "left")
    return rows.groupBy("rule").agg(F.count("*").alias("markets"), F.count_if((F.col("payout_yes") > 0) & (F.col("payout_yes") < 1)).alias("fractional"))


def fractional_payouts(markets: DataFrame, labels: DataFrame) -> DataFrame:
    """(market_id, question, payout_yes, event_at, tier): the markets that pay a fraction, with the evidence of it."""
    rows = labels.where("payout_yes > 0 and payout_yes < 1").join(markets.select("market_id", "question"), "market_id", "left")
    return rows.select("market_id", "question", "payout_yes", "event_at", "tier")


def admission_counts(tape: DataFrame, activations: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule, prints, admitted, after_label): prints of activated markets, those inside the gate, and those at or after the label's time."""
    rows = tape.select("market_id", "ts").join(activations.select("market_id", "rule", "time").join(labels.select("market_id", "label_available_at"), "market_id", "left"), "market_id")
    late = F.coalesce(F.col("ts") >= F.col("label_available_at"), F.lit(False))
    return rows.groupBy("rule").agg(F.count("*").alias("prints"), F.count_if((F.col("ts") >= F.col("time")) & ~late).alias("admitted"), F.count_if(late).alias("after_label"))
