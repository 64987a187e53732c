"""Wallets' settled markets: settlements and their variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.columns import signed_shares
from tapeworks.operators.running import running

#: Variants of a market's history: all admitted prints, the last n, or the last n days before the event.
LAST_PRINTS = (500, 1000, 2000)
LAST_DAYS = (7, 28)


def settlements(tape: DataFrame, labels: DataFrame, by: tuple[str, ...] = (), clip: float = 1.0) -> DataFrame:
    """(by..., wallet, market_id, score, notional, settled_at): profit over dollars traded, clipped; labelled markets with dollars only.

    Sells are signed exposure; no opening inventory is assumed. Payouts may be fractional.
    """
    keys = [*by, "wallet", "market_id"]
    sums = tape.groupBy(*keys).agg(
        F.sum(signed_shares(F.col("side"), F.col("size"))).alias("shares"),
        F.sum(signed_shares(F.col("side"), F.col("size")) * F.col("yes_price")).alias("paid"),
        F.sum(F.col("size") * F.col("token_price")).alias("notional"),
    )
    known = labels.where("payout_yes is not null").select("market_id", "payout_yes", F.col("label_available_at").alias("settled_at"))
    out = sums.where("notional > 0").join(known, "market_id")
    score = (F.col("shares") * F.col("payout_yes") - F.col("paid")) / F.col("notional")
    return out.select(*keys, F.greatest(F.lit(-clip), F.least(F.lit(clip), score)).alias("score"), "notional", "settled_at")


def admitted(tape: DataFrame, admissions: DataFrame, labels: DataFrame) -> DataFrame:
    """Prints from the admission on and before the event's second."""
    gates = admissions.select("market_id", "admitted_at").join(labels.select("market_id", "event_at"), "market_id")
    return tape.join(gates, "market_id").where((F.col("ts") >= F.col("admitted_at")) & (F.col("ts") < F.col("event_at")))


def gated_admissions(admissions: DataFrame, activations: DataFrame) -> DataFrame:
    """(market_id, rule, admitted_at): admission by a rule's activation, never earlier than by volume; a market that either lacks has none."""
    return activations.select("market_id", "rule", "time").join(admissions.select("market_id", "admitted_at"), "market_id").select("market_id", "rule", F.greatest("admitted_at", "time").alias("admitted_at"))


def history_variants(tape: DataFrame, admissions: DataFrame, labels: DataFrame) -> DataFrame:
    """Admitted prints with a column variant, once for each variant to which they belong."""
    rows = running(admitted(tape, admissions, labels), ["market_id"], "ts", ["ts", "seq"], {"nth": F.lit(1)})
    # the place from the end: prints of the market, less those before
    rows = rows.join(rows.groupBy("market_id").agg(F.max("nth").alias("prints")), "market_id").withColumn("back", F.col("prints") - F.col("nth") + 1)
    named = [F.lit("all"), *[F.when(F.col("back") <= n, F.lit(f"last_{n}")) for n in LAST_PRINTS], *[F.when(F.col("ts") >= F.col("event_at") - n * 86400, F.lit(f"days_{n}")) for n in LAST_DAYS]]
    return rows.withColumn("variant", F.explode(F.array_compact(F.array(*named)))).select("variant", *tape.columns)
