"""Hourly bars, admission and activation gates of the tape.

A hot market's prints are summed to (market, hour) or (market, second) before any window sees
them, so windows run over bars, whose number per market is bounded by the clock.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.running import running

HOUR = 3600
#: Rules of one aggregation.
RULES = 32


def hourly_bars(tape: DataFrame) -> DataFrame:
    """(market_id, hour, quantity, price_quantity, dollars, prints, first_ts); hour: whole hours since the epoch, first_ts: second of the hour's first print."""
    return tape.groupBy("market_id", F.floor(F.col("ts") / HOUR).alias("hour")).agg(
        F.sum("size").alias("quantity"),
        F.sum(F.col("size") * F.col("yes_price")).alias("price_quantity"),
        F.sum(F.col("size") * F.col("token_price")).alias("dollars"),
        F.count("*").alias("prints"),
        F.min("ts").alias("first_ts"),
    )


def dense_hours(bars: DataFrame, observed_until: int) -> DataFrame:
    """Bars for every completed hour from a market's first print on; silent hours are zero, without a first_ts.

    A bar brings the silent hours after it, so bars are not joined with a calendar.
    """
    last = observed_until // HOUR - 1
    by = Window.partitionBy("market_id").orderBy("hour")
    known = bars.where(F.col("hour") <= last).withColumn("next", F.coalesce(F.lead("hour").over(by), F.lit(last + 1)))
    hours = known.withColumn("h", F.explode(F.sequence("hour", F.col("next") - 1)))
    own = F.col("h") == F.col("hour")
    sums = [F.when(own, F.col(c)).otherwise(F.lit(0).cast(bars.schema[c].dataType)).alias(c) for c in ("quantity", "price_quantity", "dollars", "prints")]
    return hours.select("market_id", F.col("h").alias("hour"), *sums, F.when(own, F.col("first_ts")).alias("first_ts"))


def rolling_bars(bars: DataFrame, width: int) -> DataFrame:
    """Adds sums over the last width hours, their VWAP (0.5 if nothing traded), the dollars so far and the market's first print.

    bars: dense hours. A sum over the window is the running sum less the one width rows back, in
    decimals (to 10 places a bar), so that it is exact and its cost does not grow with the width.
    """
    by = Window.partitionBy("market_id").orderBy("hour")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    names = {"recent_quantity": "quantity", "recent_pq": "price_quantity", "recent_notional": "dollars", "recent_prints": "prints"}
    out = bars.withColumns({f"_{c}": F.sum(F.col(c) if c == "prints" else F.col(c).cast("decimal(28,10)")).over(so_far) for c in names.values()} | {"first_print": F.min("first_ts").over(so_far)})
    before = {r: F.coalesce(F.lag(f"_{c}", width).over(by), F.lit(0)) for r, c in names.items()}
    sums = {r: (F.col(f"_{c}") - before[r]).cast("long" if c == "prints" else "double") for r, c in names.items()}
    out = out.withColumns(sums | {"cumulative_notional": F.col("_dollars").cast("double")}).drop("first_ts", *[f"_{c}" for c in names.values()])
    vwap = F.when(F.col("recent_quantity") > 0, F.col("recent_pq") / F.col("recent_quantity")).otherwise(0.5)
    return out.withColumn("recent_yes_vwap", vwap)


def volume_admission(tape: DataFrame, min_volume: float) -> DataFrame:
    """(market_id, admitted_at, cumulative): the second after the first whole second whose dollars so far reach min_volume."""
    seconds = tape.groupBy("market_id", "ts").agg(F.sum((F.col("size") * F.col("token_price")).cast("decimal(28,4)")).alias("dollars"))
    reached = running(seconds, ["market_id"], "ts", ["ts"], {"cumulative": F.col("dollars")}).where(F.col("cumulative") >= F.lit(min_volume).cast("decimal(38,4)"))
    first = reached.groupBy("market_id").agg(F.min(F.struct("ts", "cumulative")).alias("r"))
    return first.select("market_id", (F.col("r.ts") + 1).alias("admitted_at"), F.col("r.cumulative").cast("double").alias("cumulative"))


def activation(rolled: DataFrame, markets: DataFrame, rules: DataFrame) -> DataFrame:
    """(market_id, rule, time, cumulative_notional, recent_notional, recent_prints, recent_yes_vwap, observed_hours).

    rules: rule, min_notional, rolling (dollars of the window, not all so far), min_prints,
    warmup_hours, min_conviction, max_days (null: no close horizon). The first completed hour
    that meets a rule activates the market. The warm-up counts from the second of the first print,
    so observed_hours is a fraction; both ends of the horizon are strict, and a market without a
    close never meets one.

    Rules are settings: the driver reads them, and each is a column of one aggregation by market,
    `RULES` at a time. Hours are neither multiplied by rules nor shuffled again.
    """
    settings = [r.asDict() for r in rules.collect()]
    time = (F.col("hour") + 1) * HOUR
    bars = rolled.join(markets.select("market_id", "close_at"), "market_id").select(
        "market_id",
        time.alias("time"),
        F.round("recent_notional", 4).alias("recent"),
        F.round("cumulative_notional", 4).alias("so_far"),
        F.round(F.greatest(F.col("recent_yes_vwap"), 1 - F.col("recent_yes_vwap")), 9).alias("conviction"),
        (time - F.col("first_print")).alias("seen"),
        (F.col("close_at") - time).alias("wait"),
        "cumulative_notional", "recent_notional", "recent_prints", "recent_yes_vwap",
    )
    row = F.struct("time", "cumulative_notional", "recent_notional", "recent_prints", "recent_yes_vwap", (F.col("seen") / HOUR).alias("observed_hours"))

    def met(r: dict) -> Column:
        horizon = F.lit(True) if r["max_days"] is None else F.coalesce((F.col("wait") > 0) & (F.col("wait") < r["max_days"] * 86400), F.lit(False))
        dollars = F.col("recent" if r["rolling"] else "so_far")
        return (F.col("recent_prints") >= r["min_prints"]) & (F.col("seen") >= r["warmup_hours"] * HOUR) & horizon & (dollars >= r["min_notional"]) & (F.col("conviction") >= r["min_conviction"])

    parts = []
    for a in range(0, len(settings), RULES):
        some = settings[a : a + RULES]
        first = bars.groupBy("market_id").agg(*[F.min(F.when(met(r), row)).alias(f"r{i}") for i, r in enumerate(some)])
        parts.append(first.select("market_id", F.explode(F.array(*[F.struct(F.lit(r["rule"]).alias("rule"), F.col(f"r{i}").alias("r")) for i, r in enumerate(some)])).alias("x")))
    if not parts:
        return bars.where("false").select("market_id", F.lit("").alias("rule"), "time", "cumulative_notional", "recent_notional", "recent_prints", "recent_yes_vwap", F.lit(0.0).alias("observed_hours"))
    found = reduce(DataFrame.unionByName, parts).where("x.r is not null")
    return found.select("market_id", "x.rule", "x.r.*")


def gate_tape(tape: DataFrame, activations: DataFrame, labels: DataFrame) -> DataFrame:
    """The tape's rows from a rule's activation on and before the label is known; all tape columns and rule."""
    gates = activations.select("market_id", "rule", "time").join(labels.select("market_id", "label_available_at"), "market_id", "left")
    kept = tape.join(gates, "market_id").where((F.col("ts") >= F.col("time")) & (F.col("label_available_at").isNull() | (F.col("ts") < F.col("label_available_at"))))
    return kept.select("rule", *tape.columns)


def thin_tape(tape: DataFrame, activations: DataFrame) -> DataFrame:
    """Prints from the activation on, and of each earlier UTC day the last print over the whole tape."""
    day = F.floor(F.col("ts") / 86400)
    last = tape.groupBy(day.alias("day")).agg(F.max(F.struct("ts", "market_id", "seq")).alias("l")).select(F.col("l.market_id").alias("market_id"), F.col("l.seq").alias("seq"), F.lit(True).alias("last_of_day"))
    gates = activations.groupBy("market_id").agg(F.min("time").alias("time"))
    kept = tape.join(gates, "market_id", "left").join(last, ["market_id", "seq"], "left")
    active = F.coalesce(F.col("ts") >= F.col("time"), F.lit(False))
    return kept.where(active | F.col("last_of_day").isNotNull()).select(*tape.columns, active.alias("active"))
