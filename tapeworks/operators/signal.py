"""From wallets' flow to a running consensus per market, and from signals to entry candidates.

Weights of qualifying rows are never negative (skill_threshold >= 0), so a wallet's running
weight never falls. Then the running decision needs windows only: the largest wallet is a
running maximum of running sums, breadth counts first appearances, and the sum of squares adds
c^2 - (c - w)^2 for each row. With a lookback rows also leave; that goes by blocks of a market's time.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import price_for
from tapeworks.operators.running import running
from tapeworks.operators.small import few


@dataclass(frozen=True)
class ConsensusConfig:
    skill_threshold: float = 0.03
    consensus_threshold: float = 0.6
    weighting: str = "skill_volume"
    min_wallets: int = 1
    max_wallet_share: float = 1.0
    min_directional_wallets: int = 1
    min_effective_wallets: float = 1.0
    max_directional_share: float = 1.0
    min_history_notional: float = 0.0
    min_effective_markets: float = 0.0
    min_similarity: float = 0.0
    min_positive_fraction: float = 0.0
    max_score_std: float = 1e300


DIAGNOSTICS = {"mean_history_markets": "effective_history_markets", "mean_similarity_seen": "mean_similarity", "mean_positive_fraction": "positive_history_weight_fraction", "mean_score_std": "skill_score_std"}


def qualifies(cfg: ConsensusConfig) -> Column:
    return (
        (F.col("skill") >= cfg.skill_threshold)
        & (F.col("volume") > 0)
        & (F.col("weighted_history_notional") >= cfg.min_history_notional)
        & (F.col("effective_history_markets") >= cfg.min_effective_markets)
        & (F.col("mean_similarity") >= cfg.min_similarity)
        & (F.col("positive_history_weight_fraction") >= cfg.min_positive_fraction)
        & (F.col("skill_score_std") <= cfg.max_score_std)
    )


def weight(cfg: ConsensusConfig) -> Column:
    return {"skill_volume": F.col("skill") * F.col("volume"), "volume": F.col("volume"), "skill": F.col("skill"), "equal": F.lit(1.0)}[cfg.weighting]


def observations(trades: DataFrame, skills: DataFrame) -> DataFrame:
    """Rows of flow: direction and shares (volume) of each trade with its wallet's statistics at that time."""
    from tapeworks.functions.columns import trade_direction

    flow = trades.select("market_id", "seq", "ts", "wallet", "yes_price", trade_direction(F.col("side")).alias("direction"), F.col("size").alias("volume"))
    return flow.join(skills.withColumnsRenamed({"weighted_score": "skill", "weighted_score_std": "skill_score_std"}).drop("wallet"), ["market_id", "seq"])


def decision(rows: DataFrame, cfg: ConsensusConfig, keep: list[str]) -> DataFrame:
    """The decision columns from yes, no, wallets, largest and, per direction d, wallets_d, squares_d, largest_d and the four sums."""
    total = F.col("yes") + F.col("no")
    none = (F.col("wallets") < max(1, cfg.min_wallets)) | (total <= 0)
    share = F.col("largest") / total
    concentrated = share > cfg.max_wallet_share
    yes_ratio, no_ratio = F.col("yes") / total, F.col("no") / total
    direction = F.when(none | concentrated, None).when(yes_ratio >= cfg.consensus_threshold, F.lit("YES")).when(no_ratio >= cfg.consensus_threshold, F.lit("NO"))
    out = rows.withColumns({"direction": direction, "total_weight": F.when(none, 0.0).otherwise(total), "wallet_share": F.when(none, 0.0).otherwise(share)})
    yes = F.col("direction") == "YES"
    side = F.when(yes, F.col("yes")).otherwise(F.col("no"))
    has = F.col("direction").isNotNull()

    def of(name: str) -> Column:
        return F.when(yes, F.col(f"{name}_YES")).otherwise(F.col(f"{name}_NO"))

    def or_zero(c: Column) -> Column:
        return F.when(has, c).otherwise(0.0)

    confidence = F.when(none | concentrated, 0.0).when(yes, yes_ratio).when(F.col("direction") == "NO", no_ratio).otherwise(F.greatest(yes_ratio, no_ratio))
    out = out.withColumns(
        {
            "confidence": confidence,
            "directional_wallets": F.when(has, of("wallets")).otherwise(0).cast("long"),
            "effective_wallets": or_zero(side * side / of("squares")),
            "directional_share": or_zero(of("largest") / side),
            **{n: or_zero(of(n) / side) for n in DIAGNOSTICS},
        }
    )
    trade = has & (F.col("directional_wallets") >= cfg.min_directional_wallets) & (F.round("effective_wallets", 9) >= cfg.min_effective_wallets) & (F.round("directional_share", 9) <= cfg.max_directional_share)
    return out.withColumn("should_trade", trade).select(*keep, "should_trade", "direction", "confidence", "total_weight", F.col("wallets").cast("long").alias("skilled_wallets"), "wallet_share", "directional_wallets", "effective_wallets", "directional_share", *DIAGNOSTICS)


def consensus(obs: DataFrame, cfg: ConsensusConfig, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One decision for each observation, over the market's qualifying rows up to and with it. keep: as in `running`, for the rows with their wallets' sums."""
    if cfg.skill_threshold < 0 and cfg.weighting in ("skill", "skill_volume"):
        raise ValueError("a negative skill_threshold lets weights fall; use rolling_consensus without a lookback")
    ok = qualifies(cfg)
    w = F.when(ok, weight(cfg)).otherwise(0.0)
    rows = obs.withColumnsRenamed({"direction": "side_of"}).withColumns({"ok": ok, "w": w})
    order = ["ts", "seq"]
    wallet = Window.partitionBy("market_id", "wallet").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wallet_d = Window.partitionBy("market_id", "wallet", "side_of").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"of_wallet": F.sum("w").over(wallet), "nth": F.sum(F.col("ok").cast("int")).over(wallet)})
    rows = rows.withColumns({"of_side": F.sum("w").over(wallet_d), "nth_side": F.sum(F.col("ok").cast("int")).over(wallet_d)})
    sums = {
        "yes": F.when(F.col("side_of") == "YES", F.col("w")).otherwise(0.0),
        "no": F.when(F.col("side_of") == "NO", F.col("w")).otherwise(0.0),
        "wallets": (F.col("ok") & (F.col("nth") == 1)).cast("int"),
    }
    maxes = {"largest": F.when(F.col("ok"), F.col("of_wallet")).otherwise(0.0)}
    for d in ("YES", "NO"):
        here = F.col("ok") & (F.col("side_of") == d)
        c = F.col("of_side")
        sums[f"wallets_{d}"] = (here & (F.col("nth_side") == 1)).cast("int")
        sums[f"squares_{d}"] = F.when(here, c * c - (c - F.col("w")) * (c - F.col("w"))).otherwise(0.0)
        maxes[f"largest_{d}"] = F.when(here, c).otherwise(0.0)
        for name, column in DIAGNOSTICS.items():
            sums[f"{name}_{d}"] = F.when(here, F.col("w") * F.col(column)).otherwise(0.0)
    return decision(running(rows, ["market_id"], "ts", order, sums, maxes, keep), cfg, ["market_id", "seq", "ts", "yes_price"])


def batch_consensus(obs: DataFrame, cfg: ConsensusConfig) -> DataFrame:
    """One decision for each market with a qualifying row, over all of its rows."""
    rows = obs.where(qualifies(cfg)).withColumn("w", weight(cfg))
    sides = rows.groupBy("market_id", "wallet", "direction").agg(F.sum("w").alias("c"), *[F.sum(F.col("w") * F.col(col)).alias(n) for n, col in DIAGNOSTICS.items()])
    wallets = sides.groupBy("market_id", "wallet").agg(
        F.sum("c").alias("of_wallet"),
        *[F.sum(F.when(F.col("direction") == d, F.col("c"))).alias(f"c_{d}") for d in ("YES", "NO")],
        *[F.sum(F.when(F.col("direction") == d, F.col(n))).alias(f"{n}_{d}") for n in DIAGNOSTICS for d in ("YES", "NO")],
    )
    zero = F.lit(0.0)
    parts = [F.count("*").alias("wallets"), F.max("of_wallet").alias("largest"), F.coalesce(F.sum("c_YES"), zero).alias("yes"), F.coalesce(F.sum("c_NO"), zero).alias("no")]
    for d in ("YES", "NO"):
        c = F.col(f"c_{d}")
        parts += [F.count(c).alias(f"wallets_{d}"), F.coalesce(F.sum(c * c), zero).alias(f"squares_{d}"), F.coalesce(F.max(c), zero).alias(f"largest_{d}")]
        parts += [F.coalesce(F.sum(f"{n}_{d}"), zero).alias(f"{n}_{d}") for n in DIAGNOSTICS]
    return decision(wallets.groupBy("market_id").agg(*parts), cfg, ["market_id"])


class Largest:
    """The largest of values that change one by one: a heap in which outdated entries stay until they come up."""

    def __init__(self) -> None:
        self.now: dict = {}
        self.heap: list = []

    def set(self, key: Hashable, value: float | None) -> None:
        if value is None:
            self.now.pop(key, None)
        else:
            self.now[key] = value
            heapq.heappush(self.heap, (-value, key))
        if len(self.heap) > 2 * len(self.now) + 64:
            self.heap = [(-v, k) for k, v in self.now.items()]
            heapq.heapify(self.heap)

    def value(self) -> float:
        while self.heap and self.now.get(self.heap[0][1]) != -self.heap[0][0]:
            heapq.heappop(self.heap)
        return -self.heap[0][0] if self.heap else 0.0


class Flow:
    """Running flow of one market: sums by wallet and direction, and what a decision needs of them, kept as prints come and go.

    A print costs the logarithm of the number of wallets.
    """

    def __init__(self, cfg: dict):
        self.cfg, self.by, self.count = cfg, {}, {}
        self.sums = {"YES": [0.0] * 5, "NO": [0.0] * 5}
        self.squares = {"YES": 0.0, "NO": 0.0}
        self.wallets = {d: Largest() for d in ("YES", "NO", "both")}

    def weigh(self, row: dict) -> float | None:
        c = self.cfg
        limits = ((row["skill"], c["skill_threshold"]), (row["weighted_history_notional"], c["min_history_notional"]), (row["effective_history_markets"], c["min_effective_markets"]), (row["mean_similarity"], c["min_similarity"]), (row["positive_history_weight_fraction"], c["min_positive_fraction"]))
        if row["volume"] <= 0 or row["skill_score_std"] > c["max_score_std"] or any(x < low for x, low in limits):
            return None
        return {"skill_volume": row["skill"] * row["volume"], "volume": row["volume"], "skill": row["skill"], "equal": 1.0}[c["weighting"]]

    def put(self, wallet: Hashable, direction: str, weight: float, count: int) -> None:
        """Sets what a wallet has in a direction; count 0: nothing."""
        key, side = (wallet, direction), self.wallets[direction]
        self.squares[direction] -= self.by.get(key, 0.0) ** 2
        if count:
            self.by[key], self.count[key] = weight, count
            self.squares[direction] += weight**2
        else:
            self.by.pop(key, None)
            self.count.pop(key, None)
        side.set(wallet, self.by.get(key))
        if not side.now:
            self.squares[direction] = 0.0
        own = [self.by[wallet, d] for d in ("YES", "NO") if (wallet, d) in self.by]
        self.wallets["both"].set(wallet, sum(own) if own else None)

    def add(self, wallet: Hashable, direction: str, count: int, sums: tuple) -> None:
        """Takes in what a wallet has in a direction: observations, weight and the four weighted sums."""
        key = (wallet, direction)
        self.put(*key, self.by.get(key, 0.0) + sums[0], self.count.get(key, 0) + count)
        for i, x in enumerate(sums):
            self.sums[direction][i] += x

    def apply(self, row: dict, sign: int) -> None:
        w = self.weigh(row)
        if w is None:
            return
        key = (row["wallet"], row["direction"])
        self.put(*key, self.by.get(key, 0.0) + sign * w, self.count.get(key, 0) + sign)
        for i, x in enumerate((1.0, *(row[c] for c in DIAGNOSTICS.values()))):
            self.sums[row["direction"]][i] += sign * w * x

    def decide(self) -> tuple:
        """yes, no, wallets, largest, then for YES and NO: wallets, squares, largest, four sums."""
        out = [max(0.0, self.sums["YES"][0]), max(0.0, self.sums["NO"][0]), len(self.wallets["both"].now), max(0.0, self.wallets["both"].value())]
        for d in ("YES", "NO"):
            out += [len(self.wallets[d].now), max(0.0, self.squares[d]), max(0.0, self.wallets[d].value()), *self.sums[d][1:]]
        return tuple(out)


FLOW_COLUMNS = ["yes", "no", "wallets", "largest", *[f"{n}_{d}" for d in ("YES", "NO") for n in ("wallets", "squares", "largest", *DIAGNOSTICS)]]
_OBS = ["wallet", "direction", "volume", "skill", "weighted_history_notional", *DIAGNOSTICS.values()]


def _block_seconds(lookback: int) -> int:
    """The largest part of a lookback that is no more than a 24th of it, and an hour at least, and divides it; else all of it."""
    return next((lookback // m for m in range(24, 0, -1) if lookback % m == 0 and (lookback // m >= 3600 or m == 1)), lookback) or 1


#: Rows of a market that a block of its time may have before blocks are made shorter.
BLOCK_ROWS = 200_000


def _blocks(obs: DataFrame, lookback: int) -> int:
    """Seconds of a block: the longest part of a lookback, down to `_block_seconds`, in which no market has more than `BLOCK_ROWS` rows; half as many blocks are half as many sums to merge."""
    least = _block_seconds(lookback)
    n = lookback // least if lookback else 0
    if n < 2:
        return least
    most = obs.groupBy("market_id", F.floor(F.col("ts") / least)).count().agg(F.max("count")).first()[0] or 0
    return lookback // next((m for m in range(1, n) if n % m == 0 and most * (n // m) <= BLOCK_ROWS), n)


def rolling_consensus(obs: DataFrame, cfg: ConsensusConfig, lookback: int) -> DataFrame:
    """Like consensus, but an observation older than lookback seconds (strictly) has left; it leaves at the next print of its market, after that was added.

    A market's time is cut into blocks, a part of the lookback each, and a block is a task of its
    own: it gets its rows, those of the block that expires meanwhile, and what the blocks
    in between add up to by wallet and direction. Those sums are made once for each block and merge
    over the blocks of a lookback. Inside a block a row costs the logarithm of the wallets. Blocks are as long as
    `BLOCK_ROWS` allows, as the sums of a block go to each block of the lookback after it; rows that do not qualify
    move without what was observed, and not to the block in which they would expire.
    """
    from collections import deque

    settings, width = asdict(cfg), _blocks(obs, lookback)
    n = lookback // width if lookback else 0
    columns = ["market_id", "seq", "ts", "yes_price", *FLOW_COLUMNS]
    sums = ["w", *[f"s_{c}" for c in DIAGNOSTICS.values()]]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, flow, held = None, None, deque()
        for pdf in it:
            out = []
            for row in pdf.to_dict("records"):
                key = (row["market_id"], row["block"])
                if key != now:
                    now, flow, held = key, Flow(settings), deque()
                if row["kind"] == 0:
                    flow.add(row["wallet"], row["direction"], int(row["n"]), tuple(row[c] for c in sums))
                    continue
                flow.apply(row, 1)
                held.append(row)
                if row["kind"] == 1:
                    continue
                while held[0]["ts"] < row["ts"] - lookback:
                    flow.apply(held.popleft(), -1)
                out.append((row["market_id"], row["seq"], row["ts"], row["yes_price"], *flow.decide()))
            yield pd.DataFrame(out, columns=columns)

    rows = obs.select("market_id", "seq", "ts", "yes_price", *_OBS).withColumn("block", F.floor(F.col("ts") / width))
    none = [F.lit(None).cast("double").alias(c) for c in sums]
    ok = qualifies(cfg)
    seen = ["wallet", F.when(ok, F.col("direction")).alias("direction"), F.when(ok, F.col("volume")).otherwise(0.0).alias("volume"), *[F.when(ok, F.col(c)).alias(c) for c in _OBS[3:]]]
    own = rows.select("market_id", "block", F.lit(2).alias("kind"), "seq", "ts", "yes_price", *seen, F.lit(0).cast("long").alias("n"), *none)
    parts = [own]
    if n:
        blocks = rows.select("market_id", "block").distinct()
        expiring = own.where("volume > 0").withColumns({"block": F.col("block") + n, "kind": F.lit(1)})
        parts.append(expiring.join(blocks, ["market_id", "block"], "left_semi"))
    if n > 1:
        w = weight(cfg)
        each = rows.where(qualifies(cfg)).groupBy("market_id", "wallet", "direction", "block").agg(F.count("*").alias("n"), F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(f"s_{c}") for c in DIAGNOSTICS.values()])
        later = each.withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("block") + n - 1))).join(blocks, ["market_id", "block"], "left_semi")
        merged = later.groupBy("market_id", "block", "wallet", "direction").agg(*[F.sum(c).alias(c) for c in ("n", *sums)])
        parts.append(merged.withColumn("kind", F.lit(0)))
    all_ = parts[0]
    for part in parts[1:]:
        all_ = all_.unionByName(part, allowMissingColumns=True)
    kind = obs.schema["market_id"].dataType.simpleString()
    types = ["int" if c.startswith("wallets") else "double" for c in FLOW_COLUMNS]
    schema = f"market_id {kind}, seq long, ts long, yes_price double, " + ", ".join(f"{c} {t}" for c, t in zip(FLOW_COLUMNS, types, strict=True))
    # expiring rows lie before the block's own, so the order of kinds is also that of time
    dealt = all_.repartition("market_id", "block").sortWithinPartitions("market_id", "block", "kind", "ts", "seq")
    return decision(dealt.mapInPandas(run, schema), cfg, ["market_id", "seq", "ts", "yes_price"])


def favorite_signal(trades: DataFrame) -> DataFrame:
    """Price alone: the direction whose price is 0.5 or more, with that price as confidence."""
    yes = F.col("yes_price") >= 0.5
    return trades.select("market_id", "seq", "ts", "yes_price", F.lit(True).alias("should_trade"), F.when(yes, F.lit("YES")).otherwise(F.lit("NO")).alias("direction"), F.when(yes, F.col("yes_price")).otherwise(F.round(1 - F.col("yes_price"), 4)).alias("confidence"))


def entry_candidates(signals: DataFrame, markets: DataFrame, cases: DataFrame) -> DataFrame:
    """Signals that pass the entry rules of a case, for all cases at once.

    cases: case, entry_start, entry_end (null: open), min_history, min_price, max_price,
    min_edge, consensus, high_confidence, price_low, price_high, stable_floor, lottery_low,
    lottery_high, min_days, max_days, planning_days (null: days to the scheduled close).
    """
    rows = signals.where("should_trade and direction is not null").join(markets.select("market_id", "close_at", "question"), "market_id").crossJoin(few(cases))
    rows = rows.withColumn("price", price_for(F.col("direction"), F.col("yes_price")))
    share = (F.greatest(F.col("consensus"), F.least(F.col("high_confidence"), F.col("confidence"))) - F.col("consensus")) / (F.col("high_confidence") - F.col("consensus"))
    ramp = F.when(F.col("high_confidence") <= F.col("consensus"), F.col("price_low")).otherwise(F.col("price_low") + share * (F.col("price_high") - F.col("price_low")))
    allowed = F.least(F.col("max_price"), ramp)
    bucket = F.when(F.col("price") > F.col("stable_floor"), F.lit("stable")).when(F.col("price").between(F.col("lottery_low"), F.col("lottery_high")), F.lit("lottery"))
    wait = F.coalesce(F.col("planning_days") * 86400, F.col("close_at") - F.col("ts"))
    rows = rows.withColumns({"allowed_price": F.round(allowed, 9), "bucket": bucket, "wait_days": wait / 86400})
    history = F.col("mean_history_markets") >= F.col("min_history") if "mean_history_markets" in signals.columns else F.lit(True)
    passed = (
        (F.col("entry_start").isNull() | (F.col("ts") >= F.col("entry_start")))
        & (F.col("entry_end").isNull() | (F.col("ts") <= F.col("entry_end")))
        & history
        & F.col("price").between(F.col("min_price"), F.col("max_price"))
        & (F.round(F.col("confidence") - F.col("price"), 9) >= F.col("min_edge"))
        & (F.col("price") <= F.col("allowed_price"))
        & F.col("bucket").isNotNull()
        & (F.col("wait_days") > F.col("min_days"))
        & (F.col("wait_days") < F.col("max_days"))
    )
    return rows.where(passed).select("case", "market_id", "seq", "ts", "direction", "confidence", "price", "allowed_price", "bucket", "wait_days", "question")


def first_entries(candidates: DataFrame) -> DataFrame:
    """The first candidate of each case and market, as its one parent order."""
    rest = [c for c in candidates.columns if c not in ("case", "market_id")]
    first = candidates.groupBy("case", "market_id").agg(F.min_by(F.struct(*rest), F.struct("ts", "seq")).alias("f"))
    return first.select("case", "market_id", *[F.col(f"f.{c}").alias(c) for c in rest])
