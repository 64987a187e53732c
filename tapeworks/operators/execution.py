"""Fixed-stake execution: stakes, fills at later prints, settlement, daily marks, stress.

A parent order has its stake from the start, so markets are independent of each other and the
work is joins and windows. Orders find their fills by a forward search that stops: `price_zones`
has the least and largest price of each hour of a market and side, so an order visits only hours
that can fill or end it, and none after the hour by which it is surely filled or ended. Only the
prints of visited hours meet the order.

orders: case, market_id, direction, seq, ts (of the signal), price (then), allowed_price, stake,
quantity (a fixed lot of shares; null: the stake decides), bucket. Execution settings are columns
of cases: delay, trade_filter, expiry (null: none), slippage_bps, min_price, max_price,
stable_floor, lottery_high, max_drift_bps (null: none; from the signal's price with slippage),
wait, confirmations, participation (null: no limit), max_children, slices, min_ticket, fee_bps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import price_for, risk_class, trade_direction
from tapeworks.operators.running import running
from tapeworks.operators.small import few

Keep = Callable[[DataFrame], DataFrame] | None
#: Seconds of a price zone.
ZONE = 3600


def order_stakes(candidates: DataFrame, account: DataFrame, observed: DataFrame, cases: DataFrame) -> DataFrame:
    """Adds stake and quantity to candidates, from a given account per case (case, equity, cash, deployed, lottery_open).

    deployed: dollars in open positions and waiting orders, lottery_open: those of the lottery
    bucket. observed: market_id, seq, observed_notional (dollars of the market up to that print).
    cases: case, edge_multiplier, min_fraction, max_fraction, target_fraction, buffer_fraction,
    max_position_fraction, max_competitive_fraction, max_market_fraction, max_balance_fraction,
    max_loss_fraction, lottery_lot, lottery_max_fraction, min_ticket. A fraction of null caps nothing.

    The stake is a share of what is left to the target. A lottery order is a fixed lot (quantity)
    at its price, if all open lottery dollars then stay within their share of cash. Other stakes
    under the least ticket are 0.
    """
    rows = candidates.join(few(account), "case").join(few(cases), "case").join(observed, ["market_id", "seq"], "left")
    left = F.greatest(F.lit(0.0), F.col("equity") * F.col("target_fraction") - F.col("deployed"))
    available = F.greatest(F.lit(0.0), F.col("cash") - F.col("equity") * F.col("buffer_fraction"))
    edge = F.greatest(F.lit(0.0), F.col("confidence") - F.col("price")) * 365 / F.greatest(F.col("wait_days"), F.lit(1e-9))
    fraction = F.greatest(F.col("min_fraction"), F.least(F.col("max_fraction"), edge * F.col("edge_multiplier")))
    caps = [
        left * fraction,
        available,
        F.col("equity") * F.col("max_position_fraction"),
        F.when(risk_class(F.col("question")) == "competitive_event", F.col("equity") * F.col("max_competitive_fraction")),
        F.coalesce("observed_notional", F.lit(0.0)) * F.col("max_market_fraction"),
        F.col("cash") * F.col("max_balance_fraction"),
        F.col("cash") * F.col("max_loss_fraction"),
    ]
    lottery = F.col("bucket") == "lottery"
    lot = F.col("lottery_lot") * F.col("price")
    fits = (F.col("lottery_max_fraction") > 0) & (F.round(F.col("lottery_open") + lot, 9) <= F.round(F.col("cash") * F.col("lottery_max_fraction"), 9))
    stake = F.when(lottery, F.when(fits, lot)).when(F.least(*caps) >= F.col("min_ticket"), F.least(*caps))
    return rows.select(*candidates.columns, F.coalesce(stake, F.lit(0.0)).alias("stake"), F.when(lottery, F.col("lottery_lot")).alias("quantity"))


def observed_notional(tape: DataFrame) -> DataFrame:
    """(market_id, seq, observed_notional): the market's dollars up to and with each print."""
    rows = running(tape.select("market_id", "seq", "ts", (F.col("size") * F.col("token_price")).alias("d")), ["market_id"], "ts", ["ts", "seq"], {"observed_notional": F.col("d")})
    return rows.select("market_id", "seq", "observed_notional")


def price_zones(tape: DataFrame) -> DataFrame:
    """(market_id, hour, side, low, high, first_ts, last_ts, first_seq, prints, shares): what each hour of a market's side has at least and at most."""
    return tape.groupBy("market_id", F.floor(F.col("ts") / ZONE).alias("hour"), "side").agg(
        F.min("yes_price").alias("low"), F.max("yes_price").alias("high"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("seq").alias("first_seq"), F.count("*").alias("prints"), F.sum("size").alias("shares")
    )


def _orders(orders: DataFrame, cases: DataFrame) -> DataFrame:
    """Orders with the settings of their case: o_ columns are the order's; due, until (null: open) and most, the highest price to pay."""
    o = orders.select(*[F.col(c).alias(f"o_{c}") for c in orders.columns]).join(few(cases), F.col("o_case") == F.col("case"))
    due = F.col("o_ts") + F.col("delay")
    o = o.withColumns({"due": due, "until": due + F.col("expiry"), "o_paid": F.least(F.lit(1.0), F.round(F.col("o_price") * (1 + F.col("slippage_bps") / 10000), 9))})
    drift = F.round(F.col("o_paid") * (1 + F.col("max_drift_bps") / 10000), 9)
    return o.withColumn("most", F.least(F.col("max_price"), F.col("o_allowed_price"), drift))


def _wanted() -> Column:
    """Whether a side is of the kind that the case trades on."""
    same = trade_direction(F.col("side")) == F.col("o_direction")
    token = F.when(F.col("o_direction") == "YES", F.col("side").isin(0, 2)).otherwise(F.col("side").isin(1, 3))
    buy = F.col("side") < 2
    return (
        F.when(F.col("trade_filter") == "any", True)
        .when(F.col("trade_filter") == "signal_direction", same)
        .when(F.col("trade_filter") == "target_token", token)
        .when(F.col("trade_filter") == "target_token_buy", token & buy)
        .when(F.col("trade_filter") == "target_token_sell", token & ~buy)
    )


def _paid(yes_price: str) -> Column:
    price = price_for(F.col("o_direction"), F.col(yes_price)) * (1 + F.col("slippage_bps") / 10000)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), price)), 9)


def _judge(p: Column, q: Column | None = None) -> tuple[Column, Column, Column]:
    """(low, high, out) of a price p: under the least price, over the most, or out of the order's bucket. With q: of all prices from p to q."""
    q = p if q is None else q
    low = (q <= 0) | (q < F.col("min_price"))
    high = p > F.col("most")
    out = ((F.col("o_bucket") == "stable") & (q <= F.col("stable_floor"))) | ((F.col("o_bucket") == "lottery") & (p >= F.col("lottery_high")))
    return low, high, F.coalesce(out, F.lit(False))


def visited_hours(orders: DataFrame, zones: DataFrame, cases: DataFrame, fits_needed: Column, dollars_needed: Column | None = None) -> DataFrame:
    """The settings of each order (`_orders`) with each hour that it has to visit.

    An hour of a side is skipped if all its prices are too high for an order that waits. An hour is
    surely the last if a side's prices all end the order, or if sides whose prices all fit have, so
    far, the fits or the dollars needed. Hours before the order is due count for nothing.
    """
    o = _orders(orders, cases)
    rows = o.join(zones, F.col("o_market_id") == F.col("market_id"))
    rows = rows.where((F.col("last_ts") >= F.col("due")) & (F.col("until").isNull() | (F.col("first_ts") <= F.col("until")))).where(_wanted())
    rows = rows.withColumns({"a": _paid("low"), "b": _paid("high")}).withColumns({"p": F.least("a", "b"), "q": F.greatest("a", "b")})
    p, q = F.col("p"), F.col("q")
    low, high, out = _judge(p, q)
    some_low, some_out = _judge(p)[0], F.coalesce(((F.col("o_bucket") == "stable") & (p <= F.col("stable_floor"))) | ((F.col("o_bucket") == "lottery") & (q >= F.col("lottery_high"))), F.lit(False))
    whole = (F.col("first_ts") >= F.col("due")) & (F.col("first_seq") > F.col("o_seq")) & (F.col("until").isNull() | (F.col("last_ts") <= F.col("until")))
    fits = whole & ~some_low & (q <= F.col("most")) & ~some_out
    ends = whole & (low | (high & ~F.col("wait")) | (~some_low & (q <= F.col("most")) & out))
    key = ["o_case", "o_market_id", "hour"]
    dollars = F.when(F.col("confirmations") == 1, dollars_needed) if dollars_needed is not None else F.lit(None)
    facts = rows.where(~(high & F.col("wait"))).select(*key, F.when(fits, F.col("prints")).otherwise(0).alias("n"), F.when(fits, F.col("shares") * p).otherwise(0.0).alias("d"), ends.alias("ends"), fits_needed.cast("long").alias("need_n"), dollars.cast("double").alias("need_d"))
    hours = facts.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.max("ends").alias("ends"), F.max("need_n").alias("need_n"), F.max("need_d").alias("need_d"))
    before = Window.partitionBy("o_case", "o_market_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    enough = F.coalesce(F.max("ends").over(before), F.lit(False)) | (F.coalesce(F.sum("n").over(before), F.lit(0)) >= F.col("need_n")) | F.coalesce(F.coalesce(F.sum("d").over(before), F.lit(0.0)) >= F.col("need_d"), F.lit(False))
    left = hours.withColumn("enough", enough).where(~F.col("enough")).select(*key)
    return o.join(left, ["o_case", "o_market_id"])


def _due(orders: DataFrame, tape: DataFrame, cases: DataFrame, zones: DataFrame | None, fits_needed: Column, dollars_needed: Column | None = None, keep: Keep = None) -> DataFrame:
    """Orders with the prints of visited hours that are due, not expired and of the wanted kind, and the price that they would pay."""
    hours = visited_hours(orders, price_zones(tape) if zones is None else zones, cases, fits_needed, dollars_needed)
    hours = keep(hours) if keep else hours
    prints = tape.withColumn("hour", F.floor(F.col("ts") / ZONE))
    rows = hours.withColumn("market_id", F.col("o_market_id")).join(prints, ["market_id", "hour"])
    return rows.where((F.col("seq") > F.col("o_seq")) & (F.col("ts") >= F.col("due")) & (F.col("until").isNull() | (F.col("ts") <= F.col("until")))).where(_wanted()).withColumn("fill_price", _paid("yes_price"))


def _search(orders: DataFrame, tape: DataFrame, cases: DataFrame, zones: DataFrame | None, fits_needed: Column, dollars_needed: Column | None = None, keep: Keep = None) -> DataFrame:
    """Orders with the prints that fit them, in visited hours and before one that ends the order; nth counts them, at most fits_needed."""
    rows = _due(orders, tape, cases, zones, fits_needed, dollars_needed, keep)
    low, high, out = _judge(F.col("fill_price"))
    kills = low | (high & ~F.col("wait")) | (~low & ~high & out)
    by = Window.partitionBy("o_case", "o_market_id").orderBy("seq")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"kills": kills, "fits": ~low & ~high & ~out})
    rows = rows.withColumns({"dead": F.max("kills").over(so_far), "nth": F.sum(F.col("fits").cast("int")).over(so_far)})
    return rows.where("fits and not dead").where(F.col("nth") <= fits_needed)


def delayed_fills(orders: DataFrame, tape: DataFrame, cases: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """The fill of each order at the n-th print that fits (n: confirmations), for its whole stake, or its whole lot. zones: `price_zones` of the tape, if they are stored."""
    rows = _search(orders, tape, cases, zones, F.col("confirmations")).where(F.col("nth") == F.col("confirmations"))
    return _as_fills(rows, F.coalesce(F.col("o_quantity") * F.col("fill_price"), F.col("o_stake")), F.lit(1))


def participation_fills(orders: DataFrame, tape: DataFrame, cases: DataFrame, zones: DataFrame | None = None, keep: Keep = None) -> DataFrame:
    """Child fills of at most participation times the print, until the stake, the child limit or a rest under the least ticket.

    Without shared cash the cumulative capacity decides: a child gets the smaller of its
    capacity and what earlier capacities have left. Without a participation the first child takes
    the stake. A fixed lot is one child, whatever the print's size. keep, which writes a frame and reads it again, has the
    hours that orders visit found before prints are read, so that the shuffles of zones and of prints are not on disk at once.
    """
    needed = F.col("confirmations") + F.col("max_children") - 1
    rows = _search(orders, tape, cases, zones, needed, F.col("o_stake") / F.col("participation"), keep).where(F.col("nth") >= F.col("confirmations"))
    lot = F.col("o_quantity") * F.col("fill_price")
    capacity = F.coalesce(F.col("size") * F.col("fill_price") * F.col("participation"), F.col("o_stake"))
    rows = rows.withColumns({"child": F.col("nth") - F.col("confirmations") + 1, "capacity": capacity})
    earlier = Window.partitionBy("o_case", "o_market_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("rest", F.col("o_stake") - F.coalesce(F.sum("capacity").over(earlier), F.lit(0.0)))
    more = (F.round("rest", 9) >= F.col("min_ticket")) & (F.col("rest") > 0) & F.col("o_quantity").isNull()
    return _as_fills(rows.where((F.col("child") == 1) | more), F.coalesce(lot, F.least("rest", "capacity")), F.col("child"))


def sliced_fills(orders: DataFrame, tape: DataFrame, cases: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Equal slices of the stake (or of the lot) at successive prints that fit, each after its own confirmations, while what is left is a ticket or more."""
    rows = _search(orders, tape, cases, zones, F.col("confirmations") * F.col("slices")).where(F.col("nth") % F.col("confirmations") == 0)
    rows = rows.withColumn("slice", F.coalesce(F.col("o_quantity") * F.col("fill_price"), F.col("o_stake")) / F.col("slices"))
    earlier = Window.partitionBy("o_case", "o_market_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.greatest(F.lit(0.0), F.col("o_stake") - F.coalesce(F.sum("slice").over(earlier), F.lit(0.0))))
    first = F.col("nth") == F.col("confirmations")
    return _as_fills(rows.where(first | (F.round("left", 9) >= F.col("min_ticket"))), F.col("slice"), F.col("nth") / F.col("confirmations"))


def _as_fills(rows: DataFrame, notional: Column, child: Column) -> DataFrame:
    return rows.select(
        F.col("o_case").alias("case"),
        F.col("o_market_id").alias("market_id"),
        F.col("o_direction").alias("direction"),
        child.cast("int").alias("child"),
        "seq",
        F.col("o_ts").alias("signal_time"),
        F.col("ts").alias("filled_at"),
        "fill_price",
        notional.alias("notional"),
        (notional / F.col("fill_price")).alias("quantity"),
        (notional * F.col("fee_bps") / 10000).alias("fee"),
        F.col("o_paid").alias("signal_price"),
        F.col("size").alias("source_size"),
        F.col("side").alias("source_side"),
    )


def settle_positions(fills: DataFrame, labels: DataFrame) -> DataFrame:
    """(case, market_id, direction, quantity, avg_price, notional, fee, opened_at, resolved_at, payout, pnl), open ones with null payout; fills at or after the label's time do not count."""
    known = fills.join(labels.select("market_id", "payout_yes", F.col("label_available_at").alias("resolved_at")), "market_id", "left")
    known = known.where(F.col("resolved_at").isNull() | (F.col("filled_at") < F.col("resolved_at")))
    sums = known.groupBy("case", "market_id", "direction", "payout_yes", "resolved_at").agg(F.sum("quantity").alias("quantity"), F.sum("notional").alias("notional"), F.sum("fee").alias("fee"), F.min("filled_at").alias("opened_at"))
    payout = F.col("quantity") * F.when(F.col("direction") == "YES", F.col("payout_yes")).otherwise(1 - F.col("payout_yes"))
    return sums.select("case", "market_id", "direction", "quantity", (F.col("notional") / F.col("quantity")).alias("avg_price"), "notional", "fee", "opened_at", "resolved_at", payout.alias("payout"), (payout - F.col("notional")).alias("pnl"))


def daily_marks(fills: DataFrame, positions: DataFrame, tape: DataFrame, initial: float) -> DataFrame:
    """(case, day, cash, open_notional, open_value, unrealized, equity) at the end of each UTC day with an event of the case.

    Open positions are valued at the market's last price up to the day. Each price is the last
    of its day, so what is joined is days, not prints; a position has a row only for days on which
    it is open, and cash is carried on by case and day.
    """
    day = F.floor(F.col("ts") / 86400).alias("day")
    opened = fills.select("case", "market_id", "direction", F.floor(F.col("filled_at") / 86400).alias("day"), "quantity", "notional", (-F.col("notional") - F.col("fee")).alias("cash"))
    closed = positions.where("payout is not null").select("case", "market_id", "direction", F.floor(F.col("resolved_at") / 86400).alias("day"), (-F.col("quantity")).alias("quantity"), (-F.col("notional")).alias("notional"), F.col("payout").alias("cash"))
    moves = opened.unionByName(closed).groupBy("case", "market_id", "direction", "day").agg(F.sum("quantity").alias("quantity"), F.sum("notional").alias("notional"), F.sum("cash").alias("cash"))
    so_far = Window.partitionBy("case").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = moves.groupBy("case", "day").agg(F.sum("cash").alias("cash")).select("case", "day", (F.sum("cash").over(so_far) + initial).alias("cash"))
    # a holding lasts from one of its moves to the next, and is open if something is left
    of_position = Window.partitionBy("case", "market_id", "direction").orderBy("day")
    sums = of_position.rowsBetween(Window.unboundedPreceding, 0)
    held = moves.select("case", "market_id", "direction", F.col("day").alias("from"), F.lead("day").over(of_position).alias("to"), F.sum("quantity").over(sums).alias("quantity"), F.sum("notional").over(sums).alias("notional")).where("quantity > 1e-9")
    last = days.groupBy("case").agg(F.max("day").alias("last"))
    held = held.join(last, "case").withColumn("day", F.explode(F.sequence("from", F.least(F.coalesce(F.col("to") - 1, F.col("last")), F.col("last")))))
    held = held.join(days.select("case", "day"), ["case", "day"])
    prices = tape.select("market_id", day, "ts", "seq", "yes_price").groupBy("market_id", "day").agg(F.max_by("yes_price", F.struct("ts", "seq")).alias("yes_price"))
    needed = held.select("market_id", "day").distinct().withColumn("need", F.lit(True)).join(prices, ["market_id", "day"], "full_outer")
    filled = needed.withColumn("last_price", F.last("yes_price", True).over(Window.partitionBy("market_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))).where("need").select("market_id", "day", "last_price")
    value = F.col("quantity") * price_for(F.col("direction"), F.col("last_price"))
    open_ = held.join(filled, ["market_id", "day"], "left").groupBy("case", "day").agg(F.sum("notional").alias("open_notional"), F.sum(value).alias("open_value"))
    out = days.join(open_, ["case", "day"], "left").fillna(0.0, ["open_notional", "open_value"])
    return out.withColumns({"unrealized": F.col("open_value") - F.col("open_notional"), "equity": F.col("cash") + F.col("open_value")})


def cost_stress(fills: DataFrame, positions: DataFrame, grid: DataFrame) -> DataFrame:
    """(case, slippage_bps, fee_bps, positions, notional, fees, pnl): the same quantities at worse prices and other fees; settled positions only."""
    cells = fills.crossJoin(few(grid.select(F.col("slippage_bps").alias("slip"), F.col("fee_bps").alias("bps"))))
    price = F.least(F.lit(1.0), F.col("fill_price") * (1 + F.col("slip") / 10000))
    cost = F.col("quantity") * price
    per = cells.groupBy("case", "market_id", "slip", "bps").agg(F.sum(cost).alias("notional"), F.sum(cost * F.col("bps") / 10000).alias("fees"))
    settled = per.join(positions.where("payout is not null").select("case", "market_id", "payout"), ["case", "market_id"])
    return settled.groupBy("case", F.col("slip").alias("slippage_bps"), F.col("bps").alias("fee_bps")).agg(F.count("*").alias("positions"), F.sum("notional").alias("notional"), F.sum("fees").alias("fees"), F.sum(F.col("payout") - F.col("notional") - F.col("fees")).alias("pnl"))


def case_grid(base: DataFrame, **values: list) -> DataFrame:
    """One case for each combination of values of the named columns; the case's name is extended with them."""
    out = base
    for name, options in values.items():
        kind = base.schema[name].dataType
        out = out.drop(name).crossJoin(few(base.sparkSession.createDataFrame([(v,) for v in options], f"{name} {kind.simpleString()}")))
        out = out.withColumn("case", F.concat_ws("/", "case", F.concat(F.lit(f"{name}="), F.col(name).cast("string"))))
    return out.select(*base.columns)


def order_ends(orders: DataFrame, fills: DataFrame, tape: DataFrame, cases: DataFrame, labels: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """(case, market_id, filled, done_at): when each order stopped waiting, and its dollars filled: at the fill that left no ticket or was its last child, the print that ended it, its expiry, or the label; null: still open."""
    needed = F.col("confirmations") + F.col("max_children") - 1
    o = _orders(orders, cases)
    known = labels.select("market_id", "label_available_at")
    in_time = fills.join(known, "market_id", "left").where(F.col("label_available_at").isNull() | (F.col("filled_at") < F.col("label_available_at")))
    facts = in_time.groupBy("case", "market_id").agg(F.sum("notional").alias("filled"), F.max("child").alias("children"), F.max("filled_at").alias("last_fill"))
    ended = _ending(orders, tape, cases, zones, needed)
    rows = o.select(F.col("o_case").alias("case"), F.col("o_market_id").alias("market_id"), "o_stake", "o_quantity", "until", "max_children", "min_ticket")
    rows = rows.join(facts, ["case", "market_id"], "left").join(ended, ["case", "market_id"], "left").join(known, "market_id", "left")
    complete = F.col("o_quantity").isNotNull() | (F.col("children") >= F.col("max_children")) | (F.round(F.col("o_stake") - F.col("filled"), 9) < F.col("min_ticket"))
    done = F.least(F.when(complete, F.col("last_fill")), F.col("ended_at"), F.col("until") + 1, F.col("label_available_at"))
    return rows.select("case", "market_id", F.coalesce("filled", F.lit(0.0)).alias("filled"), done.alias("done_at"))


def _ending(orders: DataFrame, tape: DataFrame, cases: DataFrame, zones: DataFrame | None, needed: Column) -> DataFrame:
    """(case, market_id, ended_at): the first print in visited hours that ends the order by its price."""
    rows = _due(orders, tape, cases, zones, needed)
    low, high, out = _judge(F.col("fill_price"))
    kills = rows.where(low | (high & ~F.col("wait")) | (~low & ~high & out))
    return kills.groupBy(F.col("o_case").alias("case"), F.col("o_market_id").alias("market_id")).agg(F.min("ts").alias("ended_at"))


def semantic_cluster_exposure(orders: DataFrame, positions: DataFrame, pairs: DataFrame, threshold: float, ends: DataFrame | None = None) -> DataFrame:
    """(case, market_id, exposure): dollars of the case, at the order's time, in other markets of cosine threshold or more: open positions and, with ends (`order_ends`), what stable orders wait to spend.

    Orders and positions are signed events of their market: a stake comes with its order, what was
    not filled goes when the order is done, and what was filled goes with the settlement; without ends, a position
    comes when it opens. Each order asks the running sums of the markets near its own, which are
    taken day by day. Settlements and expiries of a second come before its prints; those are in order of market.
    """
    near = pairs.where(F.col("cosine") >= threshold).select(F.col("target").alias("asks"), F.col("other").alias("market_id"))
    settled = positions.where("resolved_at is not null").select("case", "market_id", F.col("resolved_at").alias("at"), F.lit(0).alias("kind"), (-F.col("notional")).alias("moved"))
    if ends is None:
        moves = positions.select("case", "market_id", F.col("opened_at").alias("at"), F.lit(1).alias("kind"), F.col("notional").alias("moved")).unionByName(settled)
    else:
        stable = orders.where("bucket = 'stable'").select("case", "market_id", "ts", "stake")
        rest = stable.join(ends, ["case", "market_id"])
        moves = stable.select("case", "market_id", F.col("ts").alias("at"), F.lit(1).alias("kind"), F.col("stake").alias("moved"))
        moves = moves.unionByName(rest.where("done_at is not null").select("case", "market_id", F.col("done_at").alias("at"), F.lit(0).alias("kind"), (F.col("filled") - F.col("stake")).alias("moved")))
        lots = positions.join(orders.where("bucket = 'lottery'").select("case", "market_id"), ["case", "market_id"], "left_semi")
        moves = moves.unionByName(lots.select("case", "market_id", F.col("opened_at").alias("at"), F.lit(1).alias("kind"), F.col("notional").alias("moved"))).unionByName(settled)
    asked = orders.select("case", F.col("market_id").alias("asks"), "ts").join(near, "asks").where("asks != market_id")
    asked = asked.join(moves.select("case", "market_id").distinct(), ["case", "market_id"], "left_semi")
    order = F.struct("kind", F.when(F.col("kind") == 1, F.col("by")).alias("by"), F.col("asks").isNotNull().alias("asking"))
    events = moves.withColumns({"by": F.col("market_id"), "asks": F.lit(None).cast(moves.schema["market_id"].dataType)}).unionByName(
        asked.select("case", "market_id", F.col("ts").alias("at"), F.lit(1).alias("kind"), F.lit(0.0).alias("moved"), F.col("asks").alias("by"), "asks")
    )
    summed = running(events.withColumn("order", order), ["case", "market_id"], "at", ["at", "order", "asks"], {"open": F.col("moved")})
    sums = summed.where("asks is not null").groupBy("case", F.col("asks").alias("market_id")).agg(F.sum(F.greatest("open", F.lit(0.0))).alias("exposure"))
    return orders.select("case", "market_id").join(sums, ["case", "market_id"], "left").fillna(0.0, ["exposure"])
