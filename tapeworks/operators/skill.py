"""What a wallet's settled markets say at the time of a trade (as-of skill).

All statistics come from additive sums over the settlements visible at the trade (settled_at <=
ts), so they are running sums over one event table of settlements and trades; the row of the
trade's own market is taken out again. No trade meets each of its settlements. Sums run inside a
day, and over the days' totals before it, so that a wallet of very many trades is many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.running import running

SUMS = ("n", "w", "w2", "ws", "ws2", "wpos", "notional")
#: Of the dense mode: targets and settlements of a block, and trades of a target that stay together.
TARGETS, HISTORY, TRADES_LOG2 = 4096, 16384, 15
#: Cells of a product that are held at once; blocks are larger, since what is shuffled shrinks with their number.
CELLS = 512 * 2048


def _sums(weight: Column) -> dict[str, Column]:
    s = F.col("score")
    return {"n": (weight > 0).cast("long"), "w": weight, "w2": weight * weight, "ws": weight * s, "ws2": weight * s * s, "wpos": F.when(s > 0, weight).otherwise(0.0), "notional": F.col("notional")}


def _as_of(trades: DataFrame, facts: DataFrame, keys: list[str], names: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """Running sums of facts (keys, at, names) at each trade (keys, id, ts, carry), facts of the same second included."""
    events = facts.select(*keys, F.col("at"), F.lit(0).alias("kind"), F.lit(None).cast(trades.schema["market_id"].dataType).alias("market_id"), F.lit(None).cast("long").alias("seq"), *[F.lit(None).cast(trades.schema[c].dataType).alias(c) for c in carry], *names).unionByName(
        trades.select(*keys, F.col("ts").alias("at"), F.lit(1).alias("kind"), "market_id", "seq", *carry, *[F.lit(0.0).alias(n) if n != "n" else F.lit(0).cast("long").alias(n) for n in names])
    )
    # facts come before the trades of their second
    summed = running(events, keys, "at", ["at", "kind", "market_id", "seq"], {f"s_{n}": F.col(n) for n in names})
    return summed.where("kind = 1").select(*keys, "market_id", "seq", *carry, *[F.col(f"s_{n}").alias(n) for n in names])


OWN = ("own_score", "own_notional")


def _with_own(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Trades with the score and dollars of the wallet's own settlement in the market, null if it has none that is visible."""
    own = facts.select("wallet", F.col("other").alias("market_id"), F.col("at").alias("own_at"), F.col("score").alias("own_score"), F.col("notional").alias("own_notional"))
    seen = F.col("own_at") <= F.col("ts")
    return rows.join(own, ["wallet", "market_id"], "left").select(*rows.columns, *[F.when(seen, F.col(c)).alias(c) for c in OWN])


def statistics(sums: DataFrame, min_weighted_history: float = 0.0) -> DataFrame:
    """The seven statistics from the sums; all zero without visible history."""
    any_ = (F.col("n") > 0) & (F.col("w") > 0)
    mean = F.col("ws") / F.col("w")

    def or_zero(c: Column) -> Column:
        return F.when(any_, c).otherwise(0.0)

    return sums.select(
        "market_id",
        "seq",
        "wallet",
        or_zero(F.when(F.col("w") >= min_weighted_history, mean).otherwise(0.0)).alias("weighted_score"),
        or_zero(F.col("w")).alias("weighted_history_notional"),
        F.when(any_, F.col("n")).otherwise(0).cast("long").alias("supporting_markets"),
        or_zero(F.col("w") * F.col("w") / F.col("w2")).alias("effective_history_markets"),
        or_zero(F.col("w") / F.col("notional")).alias("mean_similarity"),
        or_zero(F.col("wpos") / F.col("w")).alias("positive_history_weight_fraction"),
        or_zero(F.sqrt(F.greatest(F.lit(0.0), F.col("ws2") / F.col("w") - mean * mean))).alias("weighted_score_std"),
    )


def skill(trades: DataFrame, settlements: DataFrame, mode: str = "uniform", categories: DataFrame | None = None, pairs: DataFrame | None = None, min_weighted_history: float = 0.0) -> DataFrame:
    """The statistics of each trade's wallet, one row a trade (market_id, seq).

    uniform: every settled market counts by its dollars. category: only those of the target's
    category (categories: market_id, category). kernel: dollars times the weight of pairs
    (target, other, weight); settled markets without a pair do not count.
    """
    rows = trades.select("market_id", "seq", "wallet", "ts")
    facts = settlements.select("wallet", F.col("market_id").alias("other"), "score", "notional", F.col("settled_at").alias("at"))
    weight = F.col("notional")
    if mode == "kernel":
        targets = rows.select("wallet", F.col("market_id").alias("target")).distinct()
        # a wallet's targets meet the markets that are like them, then its settlements: never all its targets with all its settlements,
        # nor settlements with markets that the wallet does not trade
        wanted = targets.join(pairs.select("target", "other", "weight"), "target").where("target != other")
        weighted = wanted.join(facts, ["wallet", "other"]).withColumns(_sums(F.col("notional") * F.col("weight")))
        sums = _as_of(rows.withColumn("target", F.col("market_id")), weighted.select("wallet", "target", "at", *SUMS[:-1]), ["wallet", "target"], SUMS[:-1])
        total = _totals(rows, facts)
        return statistics(sums.join(total, ["market_id", "seq", "wallet"]), min_weighted_history)
    if mode == "category":
        rows = rows.join(categories.select("market_id", "category"), "market_id")
        facts_c = facts.join(categories.select(F.col("market_id").alias("other"), "category"), "other")
        sums = _as_of(rows, facts_c.withColumns(_sums(weight)).select("wallet", "category", "at", *SUMS[:-1]), ["wallet", "category"], SUMS[:-1]).drop("category")
        sums = sums.join(_totals(_with_own(rows, facts), facts, OWN), ["market_id", "seq", "wallet"])
        names = SUMS[:-1]
    elif mode == "uniform":
        sums = _as_of(_with_own(rows, facts), facts.withColumns(_sums(weight)).select("wallet", "at", *SUMS), ["wallet"], SUMS, OWN)
        names = SUMS
    else:
        raise ValueError(f"mode {mode!r} is not uniform, category or kernel")
    mine = _sums(F.col("notional"))
    own_sums = sums.select("market_id", "seq", "wallet", *[F.col(n).alias(f"a_{n}") for n in SUMS], F.col("own_score").alias("score"), F.col("own_notional").alias("notional"))
    less = [(F.col(f"a_{n}") - F.when(F.col("notional").isNotNull(), mine[n]).otherwise(0)).alias(n) if n in names else F.col(f"a_{n}").alias(n) for n in SUMS]
    return statistics(own_sums.select("market_id", "seq", "wallet", *less), min_weighted_history)


def _totals(rows: DataFrame, facts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(market_id, seq, wallet, notional, carry): all dollars of the wallet's visible settlements, without the target's."""
    rows = rows if carry else _with_own(rows, facts)
    all_ = _as_of(rows, facts.select("wallet", "at", "notional"), ["wallet"], ("notional",), OWN)
    return all_.select("market_id", "seq", "wallet", (F.col("notional") - F.coalesce("own_notional", F.lit(0.0))).alias("notional"), *carry)


def dense_skill(trades: DataFrame, settlements: DataFrame, vectors: DataFrame, floor: float = 0.0, threshold: float = 0.0, power: float = 1.0, normalize: bool = True, min_weighted_history: float = 0.0) -> DataFrame:
    """The statistics with every settled market's weight from its vector: dollars times the cosine with the target's (market_id, vector), at least `floor`, or a kernel of it.

    A wallet's targets and its settlements, in order of time, are cut into blocks, and each pair of
    blocks is a task: a product of matrices, sums along the settlements' time, and a search for
    each trade's time in it. The sums of a trade's blocks of settlements are added up afterwards, so
    a wallet of very many markets is many tasks. A block of settlements is left out for targets that
    were traded only before it. Settled markets without a vector do not count; a target without
    one has no statistics. No pairs of markets are written.
    """
    kind = {c: trades.schema[c].dataType.simpleString() for c in ("market_id", "wallet")}
    rows = trades.select("market_id", "seq", "wallet", "ts")
    vector = vectors.select("market_id", F.col("vector").cast("array<float>").alias("vector"))

    by_time = Window.partitionBy("wallet").orderBy("at", "other")
    facts = settlements.select("wallet", F.col("market_id").alias("other"), "score", "notional", F.col("settled_at").alias("at")).join(vector.withColumnRenamed("market_id", "other"), "other")
    facts = facts.withColumn("h", F.floor((F.row_number().over(by_time) - 1) / HISTORY).cast("int"))

    # trades of one wallet in one market, in runs of bounded length
    runs = rows.groupBy("wallet", "market_id", F.shiftright("seq", TRADES_LOG2).alias("run")).agg(F.max("ts").alias("last"))
    runs = runs.join(vector, "market_id").withColumn("t", F.floor((F.row_number().over(Window.partitionBy("wallet").orderBy("market_id", "run")) - 1) / TARGETS).cast("int"))
    blocks = runs.groupBy("wallet", "t").agg(F.max("last").alias("last"))
    spans = facts.groupBy("wallet", "h").agg(F.min("at").alias("from"))
    meets = blocks.join(spans, "wallet").where(F.col("from") <= F.col("last")).select("wallet", "t", "h")

    key = ["wallet", "t", "h"]
    asked = runs.join(meets, ["wallet", "t"])
    targets = asked.select(*key, F.lit(0).alias("kind"), "market_id", "run", F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("notional"), "vector")
    history = facts.join(meets, ["wallet", "h"]).select(*key, F.lit(1).alias("kind"), F.col("other").alias("market_id"), F.lit(None).cast("long").alias("run"), "at", "score", "notional", "vector")
    times = rows.withColumn("run", F.shiftright("seq", TRADES_LOG2)).join(asked.select(*key, "market_id", "run"), ["wallet", "market_id", "run"]).select(*[F.col(k).alias(f"of_{k}") for k in key], *[F.col(c).alias(f"its_{c}") for c in ("market_id", "run", "seq", "ts")])

    def unit(part: pd.DataFrame) -> np.ndarray:
        v = np.stack(part["vector"].to_numpy()).astype(np.float64)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def product(both: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(columns=["market_id", "seq", "wallet", *SUMS])
        asked = asked.rename(columns=lambda c: c.removeprefix("its_"))
        goal, past = both[both["kind"] == 0], both[both["kind"] == 1].sort_values("at", kind="stable")
        if not len(goal) or not len(past) or not len(asked):
            return out
        place = pd.MultiIndex.from_frame(goal[["market_id", "run"]]).get_indexer(pd.MultiIndex.from_frame(asked[["market_id", "run"]]))
        seen = np.searchsorted(past["at"].to_numpy(), asked["ts"].to_numpy(), side="right") - 1
        some = seen >= 0
        if not some.any():
            return out
        asked = asked[some]
        order = np.argsort(place[some], kind="stable")
        place, seen = place[some][order], seen[some][order]
        left, right, ids, others = unit(goal), unit(past), goal["market_id"].to_numpy(), past["market_id"].to_numpy()
        n, score = past["notional"].to_numpy(np.float64), past["score"].to_numpy(np.float64)
        got = {name: np.zeros(len(seen), np.int64 if name == "n" else np.float64) for name in SUMS}
        wide = max(1, min(len(past), CELLS // min(len(goal), 512)))
        high = max(1, CELLS // wide)
        for a in range(0, len(goal), high):
            rows = slice(*np.searchsorted(place, (a, a + high)))
            for x in range(0, len(past), wide):
                y = min(x + wide, len(past))
                last = np.minimum(seen[rows], y - 1) - x
                if not (last >= 0).any():
                    continue
                sim = np.maximum(left[a : a + high] @ right[x:y].T, floor)
                if threshold or power != 1:
                    sim = np.maximum(np.clip(sim, 0, 1) - threshold, 0)
                    sim = (sim / (1 - threshold) if normalize else sim) ** power
                other = ids[a : a + high, None] != others[x:y]
                w, s = np.where(other, sim * n[x:y], 0.0), score[x:y]
                at, in_, here = place[rows] - a, np.maximum(last, 0), last >= 0
                for name, cells in (("n", lambda: w > 0), ("w", lambda: w), ("w2", lambda: w * w), ("ws", lambda: w * s), ("ws2", lambda: w * s * s), ("wpos", lambda: np.where(s > 0, w, 0.0)), ("notional", lambda: np.where(other, n[x:y], 0.0))):
                    got[name][rows] += np.where(here, np.cumsum(cells(), axis=1)[at, in_], 0)
        return pd.DataFrame({"market_id": asked["market_id"].to_numpy()[order], "seq": asked["seq"].to_numpy()[order], "wallet": both["wallet"].iloc[0], **got})

    schema = f"market_id {kind['market_id']}, seq long, wallet {kind['wallet']}, n long, " + ", ".join(f"{c} double" for c in SUMS[1:])
    parts = targets.unionByName(history).groupBy(*key).cogroup(times.groupBy(*[f"of_{k}" for k in key])).applyInPandas(product, schema)
    sums = parts.groupBy("market_id", "seq", "wallet").agg(*[F.sum(c).alias(c) for c in SUMS])
    full = rows.select("market_id", "seq", "wallet").join(sums, ["market_id", "seq", "wallet"], "left").fillna(0, list(SUMS))
    return statistics(full, min_weighted_history)
