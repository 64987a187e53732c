"""Comparisons of runs and audits of saved accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import price_for, trade_direction
from tapeworks.operators.running import running
from tapeworks.operators.small import few
from tapeworks.operators.signal import ConsensusConfig


def compare_positions(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: what two position tables (market_id, direction, opened_at, avg_price, notional, pnl) share. A repeated market in either is an error."""
    key = [c.select("market_id").groupBy("market_id").count().agg(F.max("count").alias("m")) for c in (a, b)]
    unique = reduce(DataFrame.unionByName, key).agg(F.max("m").alias("most"))
    x = a.select("market_id", *[F.col(c).alias(f"a_{c}") for c in ("direction", "opened_at", "avg_price", "notional", "pnl")])
    y = b.select("market_id", *[F.col(c).alias(f"b_{c}") for c in ("direction", "opened_at", "avg_price", "notional", "pnl")])
    both = x.join(y, "market_id", "full_outer").crossJoin(F.broadcast(unique))
    both = both.where(F.when(F.col("most") > 1, F.raise_error(F.lit("a market has two positions"))).otherwise(F.lit(True)).cast("boolean"))
    left, right = F.col("a_direction").isNotNull(), F.col("b_direction").isNotNull()
    same = F.col("a_direction") == F.col("b_direction")
    return both.agg(
        F.count_if(left & right).alias("shared"),
        F.count_if(same).alias("same_direction"),
        F.count_if(~same).alias("opposite_direction"),
        F.count_if(left & ~right).alias("only_left"),
        F.count_if(right & ~left).alias("only_right"),
        (F.count_if(left & right) / F.count("*")).alias("market_jaccard"),
        (F.count_if(same) / F.count("*")).alias("direction_jaccard"),
        F.count_if(F.col("a_opened_at") == F.col("b_opened_at")).alias("same_time"),
        F.count_if(F.abs(F.col("a_avg_price") - F.col("b_avg_price")) < 1e-9).alias("same_price"),
        F.count_if((F.col("a_pnl") < 0) & (F.col("b_pnl") < 0)).alias("losses_repeated"),
        F.count_if((F.col("a_pnl") < 0) & ~right).alias("losses_avoided"),
        F.coalesce(F.sum(F.when(~right, F.col("a_pnl"))), F.lit(0.0)).alias("only_left_pnl"),
        F.coalesce(F.sum(F.when(~left, F.col("b_pnl"))), F.lit(0.0)).alias("only_right_pnl"),
        F.coalesce(F.sum(F.when(~right, F.col("a_notional"))), F.lit(0.0)).alias("only_left_notional"),
        F.coalesce(F.sum(F.when(~left, F.col("b_notional"))), F.lit(0.0)).alias("only_right_notional"),
    )


def consolidate_runs(runs: list[DataFrame], key: str = "case") -> DataFrame:
    """The rows of several runs, the last run winning for each key; a missing fill_ratio is filled / requested."""
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [r.withColumn("run", F.lit(i)) for i, r in enumerate(runs)])
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("run")))
    out = rows.withColumn("rn", last).where("rn = 1").drop("rn")
    if {"fill_ratio", "filled", "requested"} <= set(out.columns):
        out = out.withColumn("fill_ratio", F.coalesce("fill_ratio", F.when(F.col("requested") > 0, F.col("filled") / F.col("requested"))))
    return out


def metric_checks(actual: DataFrame, expected: DataFrame, metrics: list[str], tolerance: float = 1e-8) -> DataFrame:
    """(case, metric, actual, expected, ok): each metric of two summaries, within a relative or absolute tolerance."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select("case", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot("case", metrics, "metric", name)

    rows = long(actual, "actual").join(long(expected, "expected"), ["case", "metric"], "full_outer")
    close = F.abs(F.col("actual") - F.col("expected")) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs("actual"), F.abs("expected")))
    return rows.withColumn("ok", F.coalesce(close, F.col("actual").isNull() & F.col("expected").isNull()))


def audit_cash(fills: DataFrame, positions: DataFrame, initial: float) -> DataFrame:
    """(case, final_cash, min_cash, negative): cash after each event, payouts before fills of the same second."""
    paid = positions.where("payout is not null").select("case", F.col("resolved_at").alias("ts"), F.lit(0).alias("kind"), "market_id", F.lit(0).alias("i"), F.col("payout").alias("moved"))
    spent = fills.select("case", F.col("filled_at").alias("ts"), F.lit(1).alias("kind"), "market_id", F.col("child").alias("i"), (-F.col("notional") - F.col("fee")).alias("moved"))
    order = ["ts", "kind", "market_id", "i"]
    rows = running(paid.unionByName(spent), ["case"], "ts", order, {"cash": F.col("moved")}).withColumn("cash", F.col("cash") + initial)
    out = rows.groupBy("case").agg(F.max_by("cash", F.struct(*order)).alias("final_cash"), F.least(F.min("cash"), F.lit(initial)).alias("min_cash"))
    return out.withColumn("negative", F.col("min_cash") < -1e-9)


def audit_fills(fills: DataFrame, tape: DataFrame, activations: DataFrame, orders: DataFrame, cases: DataFrame, labels: DataFrame, signals: DataFrame | None = None, limits: ConsensusConfig | None = None, tolerance: float = 1e-12) -> DataFrame:
    """Each fill against the rules: gate <= signal <= fill, delay, expiry, prices, participation, token, identities, finality, the signal behind it and the prints that could be its source.

    activations: market_id, time (one a market). labels: market_id, label_available_at, tier. The
    source has the fill's second, size and side and, with slippage, its price; the quote is a print
    of the signal's second with the signal's price, inside the case's prices and edge. With signals
    and limits the order's signal must meet them.
    """
    key = ["case", "market_id", "child"]
    order = orders.select("case", "market_id", "allowed_price", "stake", F.col("seq").alias("signal_seq"), "confidence", F.col("quantity").alias("lot"))
    rows = fills.join(few(cases), "case").join(order, ["case", "market_id"], "left").join(activations.select("market_id", "time"), "market_id", "left").join(labels.select("market_id", "label_available_at", "tier"), "market_id", "left")

    def paid(yes_price: str) -> Column:
        return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), price_for(F.col("direction"), F.col(yes_price)) * (1 + F.col("slippage_bps") / 10000))), 9)

    raw = price_for(F.col("direction"), F.col("yes_price"))
    # a fill asks the prints of two seconds, that of its source and that of its signal, so the tape meets all of them in one join
    asks = [F.col("slippage_bps"), "direction"]
    of_source = rows.select(*key, F.col("filled_at").alias("ts"), F.lit(True).alias("is_source"), *asks, F.col("source_size").alias("a_size"), F.col("source_side").alias("a_side"), F.col("fill_price").alias("price"))
    of_quote = rows.select(*key, F.col("signal_time").alias("ts"), F.lit(False).alias("is_source"), *asks, F.col("signal_price").alias("price"), "min_price", "max_price", "min_edge", F.col("confidence").alias("a_confidence"))
    asked = of_source.unionByName(of_quote, allowMissingColumns=True)
    met_print = asked.join(tape.select("market_id", "ts", "size", "side", "yes_price"), ["market_id", "ts"]).where(F.abs(paid("yes_price") - F.col("price")) <= tolerance)
    is_quote = ~F.col("is_source") & raw.between(F.col("min_price"), F.col("max_price")) & (F.col("a_confidence") - raw + 1e-9 >= F.col("min_edge"))
    found = met_print.groupBy(*key).agg(F.count_if(F.col("is_source") & (F.col("size") == F.col("a_size")) & (F.col("side") == F.col("a_side"))).alias("sources"), F.max(F.coalesce(is_quote, F.lit(False))).alias("quote_ok"))
    ratio = F.col("quantity") / F.col("source_size")
    target = F.when(F.col("direction") == "YES", F.col("source_side").isin(0, 2)).otherwise(F.col("source_side").isin(1, 3))
    buy = F.col("source_side") < 2
    wanted = F.when(F.col("trade_filter") == "target_token", target).when(F.col("trade_filter") == "target_token_buy", target & buy).when(F.col("trade_filter") == "target_token_sell", target & ~buy).when(F.col("trade_filter") == "signal_direction", trade_direction(F.col("source_side")) == F.col("direction")).otherwise(True)
    near = lambda x, y: F.abs(x - y) <= 2e-6
    out = rows.join(found, key, "left")
    checks = [
        F.coalesce((F.col("time") <= F.col("signal_time")) & (F.col("signal_time") <= F.col("filled_at")), F.lit(False)).alias("in_gate"),
        (F.col("filled_at") >= F.col("signal_time") + F.col("delay")).alias("delayed"),
        (F.col("expiry").isNull() | (F.col("filled_at") <= F.col("signal_time") + F.col("delay") + F.col("expiry"))).alias("in_time"),
        (F.col("label_available_at").isNull() | (F.col("filled_at") < F.col("label_available_at"))).alias("before_label"),
        (F.col("fill_price") <= F.col("allowed_price") + 1e-9).alias("under_cap"),
        (F.col("fill_price").between(F.col("min_price"), F.col("max_price")) & F.coalesce(F.col("fill_price") <= F.col("signal_price") * (1 + F.col("max_drift_bps") / 10000) + 1e-9, F.lit(True))).alias("price_ok"),
        F.coalesce(ratio <= F.col("participation") + 1e-9, F.lit(True)).alias("in_participation"),
        wanted.alias("wanted_side"),
        target.alias("target_token"),
        (near(F.col("notional"), F.col("quantity") * F.col("fill_price")) & near(F.col("fee"), F.col("notional") * F.col("fee_bps") / 10000) & (F.col("lot").isNotNull() | (F.col("notional") <= F.col("stake") + 2e-6))).alias("identities_ok"),
        F.coalesce("quote_ok", F.lit(False)).alias("quote_ok"),
        ratio.alias("print_ratio"),
        F.coalesce("sources", F.lit(0)).cast("long").alias("sources"),
        "tier",
    ]
    if signals is None or limits is None:
        return out.select(*key, *checks)
    s = signals.select("market_id", F.col("seq").alias("signal_seq"), F.col("direction").alias("signal_direction"), "should_trade", F.col("confidence").alias("signal_confidence"), "skilled_wallets", "wallet_share", "directional_wallets", "effective_wallets", "directional_share", "mean_history_markets")
    met = (
        F.col("should_trade")
        & (F.col("signal_direction") == F.col("direction"))
        & (F.col("signal_confidence") >= F.greatest(F.lit(limits.consensus_threshold), F.col("consensus")) - 1e-9)
        & (F.col("skilled_wallets") >= limits.min_wallets)
        & (F.col("directional_wallets") >= limits.min_directional_wallets)
        & (F.col("effective_wallets") + 1e-9 >= limits.min_effective_wallets)
        & (F.col("wallet_share") <= limits.max_wallet_share + 1e-9)
        & (F.col("directional_share") <= limits.max_directional_share + 1e-9)
        & (F.col("mean_history_markets") + 1e-9 >= F.col("min_history"))
    )
    return out.join(s, ["market_id", "signal_seq"], "left").select(*key, *checks, F.coalesce(met, F.lit(False)).alias("signal_ok"))


def audit_summary(audited: DataFrame) -> DataFrame:
    """(case, fills, failed, median_ratio, max_ratio, over_print, without_source, opposite_token, tiers) of `audit_fills`: tiers counts fills by evidence tier."""
    checks = [c for c, t in audited.dtypes if t == "boolean" and c != "target_token"]
    every = F.forall(F.array(*[F.coalesce(c, F.lit(False)) for c in checks]), lambda x: x)
    out = audited.withColumn("good", every & (F.col("sources") > 0)).groupBy("case").agg(
        F.count("*").alias("fills"),
        F.count_if(~F.col("good")).alias("failed"),
        F.percentile("print_ratio", F.lit(0.5)).alias("median_ratio"),
        F.max("print_ratio").alias("max_ratio"),
        F.count_if(F.col("print_ratio") > 1 + 1e-9).alias("over_print"),
        F.count_if(F.col("sources") == 0).alias("without_source"),
        F.count_if(~F.col("target_token")).alias("opposite_token"),
    )
    tiers = audited.groupBy("case", F.coalesce("tier", F.lit("none")).alias("tier")).count()
    tiers = tiers.groupBy("case").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "tier", "count"))), ",").alias("tiers"))  # a few kinds
    return out.join(tiers, "case")


def audit_positions(fills: DataFrame, positions: DataFrame, labels: DataFrame, orders: DataFrame, tolerance: float = 2e-6) -> DataFrame:
    """(case, market_id, quantity_ok, cost_ok, opened_ok, payout_ok, pnl_ok, budget_ok, sequence_ok): identities between fills and positions."""
    sums = fills.groupBy("case", "market_id").agg(F.sum("quantity").alias("q"), F.sum("notional").alias("n"), F.min("filled_at").alias("o"), F.count("*").alias("c"), F.max("child").alias("m"), F.countDistinct("child").alias("d"))
    rows = positions.join(sums, ["case", "market_id"], "left").join(labels.select("market_id", "payout_yes"), "market_id", "left").join(orders.select("case", "market_id", "stake"), ["case", "market_id"], "left")
    pays = F.col("quantity") * F.when(F.col("direction") == "YES", F.col("payout_yes")).otherwise(1 - F.col("payout_yes"))

    def near(x, y):
        return F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())

    return rows.select(
        "case",
        "market_id",
        near(F.col("quantity"), F.col("q")).alias("quantity_ok"),
        near(F.col("notional"), F.col("n")).alias("cost_ok"),
        F.coalesce(F.col("opened_at") == F.col("o"), F.lit(False)).alias("opened_ok"),
        near(F.col("payout"), pays).alias("payout_ok"),
        near(F.col("pnl"), F.col("payout") - F.col("notional")).alias("pnl_ok"),
        F.coalesce(F.col("n") <= F.col("stake") + tolerance, F.lit(False)).alias("budget_ok"),
        F.coalesce((F.col("m") == F.col("c")) & (F.col("d") == F.col("c")), F.lit(False)).alias("sequence_ok"),
    )


def gate_monotonicity(activations: DataFrame, rules: DataFrame) -> DataFrame:
    """(check, market_id, rule, ok): for each activation, that the next lower dollar threshold has activated too and no later (threshold), that the cumulative gate of a rolling one has (mode), and that all dollars are no less than the window's (dollars).

    rules: rule, family, min_notional, rolling. A family has the rules that differ in these two only.
    """
    kinds = rules.select("rule", "family", "min_notional", "rolling")
    lower = F.lag("rule").over(Window.partitionBy("family", "rolling").orderBy("min_notional"))
    below = kinds.withColumn("needs", lower).where("needs is not null").select(F.lit("threshold").alias("check"), "rule", "needs")
    c = kinds.where("not rolling").select("family", "min_notional", F.col("rule").alias("needs"))
    modes = kinds.where("rolling").join(c, ["family", "min_notional"]).select(F.lit("mode").alias("check"), "rule", "needs")
    times = activations.select("market_id", F.col("rule").alias("needs"), F.col("time").alias("earlier"))
    rows = activations.select("market_id", "rule", "time").join(below.unionByName(modes), "rule").join(times, ["market_id", "needs"], "left")
    pairs = rows.select("check", "market_id", "rule", F.coalesce(F.col("earlier") <= F.col("time"), F.lit(False)).alias("ok"))
    dollars = activations.select(F.lit("dollars").alias("check"), "market_id", "rule", (F.col("cumulative_notional") + 1e-6 >= F.col("recent_notional")).alias("ok"))
    return pairs.unionByName(dollars)


def compare_tapes(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: rows only in a, only in b, with the same keys but another value, and the largest difference of value."""
    x, y = a.select(*keys, F.col(value).alias("x")), b.select(*keys, F.col(value).alias("y"))
    both = x.withColumn("in_a", F.lit(True)).join(y.withColumn("in_b", F.lit(True)), keys, "full_outer")
    return both.agg(
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"),
        F.count_if(F.col("in_a") & F.col("in_b") & ~F.col("x").eqNullSafe(F.col("y"))).alias("changed"),
        F.coalesce(F.max(F.abs(F.col("x") - F.col("y"))), F.lit(0.0)).alias("max_difference"),
    )


def open_exposure(fills: DataFrame, positions: DataFrame, markets: DataFrame, as_of: int) -> DataFrame:
    """(case, market_id, question, notional, quantity, close_at, already_closed): fills without a settled position."""
    settled = positions.where("payout is not null").select("case", "market_id")
    rows = fills.join(settled, ["case", "market_id"], "left_anti").groupBy("case", "market_id").agg(F.sum("notional").alias("notional"), F.sum("quantity").alias("quantity"))
    return rows.join(markets.select("market_id", "question", "close_at"), "market_id", "left").withColumn("already_closed", F.coalesce(F.col("close_at") <= as_of, F.lit(False))).select("case", "market_id", "question", "notional", "quantity", "close_at", "already_closed")
