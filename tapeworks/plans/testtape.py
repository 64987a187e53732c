"""The driver's star schema as a trade tape, and the chain of results that the registered queries build on it.

`View` has the Spark side, `SQL` the same tables as DuckDB common table expressions.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tapeworks.operators import bars, execution, history, signal, skill, vectors
from tapeworks.operators.signal import ConsensusConfig
from tapeworks.sources import cleaning

START, DAYS = 788918400, 100
END = START + DAYS * 86400
WIDTH = 168
INITIAL, CASH = 10000.0, 8000.0
CONSENSUS = ConsensusConfig(skill_threshold=0.03, consensus_threshold=0.6, min_wallets=2, min_directional_wallets=2, max_wallet_share=0.8)
LOOKBACK = 10 * 86400
CHAIN_RULE = "open"
KERNEL = 0.2
TIERS = ("metadata_proxy", "chain_event_observed", "chain_event_reconstructed")

RULES = [  # rule, family, min_notional, rolling, min_prints, warmup_hours, min_conviction, max_days
    ("open", "open", 300.0, False, 20, 24, 0.55, None),
    ("cum300", "main", 300.0, False, 20, 24, 0.8, 28.0),
    ("cum1000", "main", 1000.0, False, 20, 24, 0.8, 28.0),
    ("roll300", "main", 300.0, True, 20, 24, 0.8, 28.0),
    ("roll400", "main", 400.0, True, 20, 24, 0.8, 28.0),
]
RULE_COLUMNS = "rule string, family string, min_notional double, rolling boolean, min_prints int, warmup_hours int, min_conviction double, max_days double"

CASE = {
    "case": "base", "entry_start": None, "entry_end": None, "min_history": 0.0, "min_price": 0.02, "max_price": 0.97, "min_edge": 0.02, "consensus": 0.6, "high_confidence": 0.9,
    "price_low": 0.6, "price_high": 0.95, "stable_floor": 0.35, "lottery_low": 0.01, "lottery_high": 0.2, "min_days": 0.0, "max_days": 60.0, "planning_days": None,
    "edge_multiplier": 0.05, "min_fraction": 0.02, "max_fraction": 0.2, "target_fraction": 0.6, "buffer_fraction": 0.1, "max_position_fraction": 0.05, "max_competitive_fraction": 0.03,
    "max_market_fraction": 0.25, "max_balance_fraction": 0.1, "max_loss_fraction": 0.08, "lottery_lot": 100.0, "lottery_max_fraction": 0.003, "min_ticket": 1.0,
    "delay": 3600, "trade_filter": "any", "expiry": 864000, "slippage_bps": 10.0, "max_drift_bps": None, "wait": True, "confirmations": 1, "participation": 0.25, "max_children": 5, "slices": 3, "fee_bps": 20.0,
}
CASES = [
    CASE,
    CASE | {"case": "token", "trade_filter": "target_token", "wait": False, "max_drift_bps": 500.0, "confirmations": 2, "min_edge": 0.05, "participation": 0.1},
    CASE | {"case": "direction", "trade_filter": "signal_direction", "delay": 0, "expiry": None, "participation": None, "min_ticket": 40.0, "lottery_max_fraction": 0.0015, "slices": 4, "max_days": 30.0, "planning_days": 7.0, "max_children": 3, "entry_start": START + 20 * 86400},
]
CASE_TYPES = {"case": "string", "trade_filter": "string", "wait": "boolean", "delay": "bigint", "expiry": "bigint", "entry_start": "bigint", "entry_end": "bigint", "confirmations": "int", "max_children": "int", "slices": "int"}


def literal(v: object) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def values(name: str, columns: dict[str, str], rows: list[tuple]) -> str:
    """A common table expression of literal rows."""
    types = {"string": "VARCHAR"}
    cast = ", ".join(f"CAST(c{i} AS {types.get(t, t)}) AS \"{c}\"" for i, (c, t) in enumerate(columns.items()))
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"{name} AS (SELECT {cast} FROM (VALUES {body}) AS v({', '.join(f'c{i}' for i in range(len(columns)))}))"


CASE_COLUMNS = {c: CASE_TYPES.get(c, "double") for c in CASE}
ACCOUNT = [(c["case"], INITIAL, CASH, 500.0, 5.0) for c in CASES]
ACCOUNT_COLUMNS = {"case": "string", "equity": "double", "cash": "double", "deployed": "double", "lottery_open": "double"}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where none is set, a temporary one in a session on one machine, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tapeworks-")
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}"


#: With this setting Spark removes a query's shuffle files, on all executors, as soon as the query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before) if before is not None else spark.conf.unset(SHUFFLE_CLEANUP)


@lru_cache(maxsize=4)
def view(application: str, spark: SparkSession, sf_dir: str) -> View:
    """The view of a folder, shared by the queries of an application, so that they share what it keeps."""
    return View(spark, sf_dir)


class View:
    """Tables of the chain, each built when it is first asked for.

    Those that several results use are written once, to a folder that all executors see, and read
    from there: the plan of a later one starts at the files of the one before, whatever it took
    to make them, and a lost executor costs no chain.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def folder(self) -> str:
        return shared_dir(self.spark)

    def kept(self, name: str, df: DataFrame) -> DataFrame:
        """df written below the folder and read from there; the shuffle files of the write go when it ends, not when the driver collects its plan."""
        with freed_shuffles(self.spark):
            df.write.option("compression", "zstd").mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def dropped(self, name: str) -> None:
        """Deletes a kept table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def markets(self) -> DataFrame:
        s, name = F.col("s_suppkey"), F.col("s_name")
        event = F.lit(789782400) + (s * 7919 % 1000) * 7344
        question = F.when(s % 3 == 0, F.concat(F.lit("Team"), s, F.lit(" vs. Team"), s + 1)).when(s % 3 == 1, F.concat(F.lit("Will "), name, F.lit(" win the cup?"))).otherwise(F.concat(F.lit("Will "), name, F.lit(" ship on time?")))
        return self.table("supplier").select(
            s.alias("market_id"),
            question.alias("question"),
            F.concat(F.lit("cat"), F.col("s_nationkey") % 5).alias("category"),
            event.alias("event_at"),
            (event + 1).alias("label_available_at"),
            (event + (s % 30) * 86400).alias("close_at"),
            F.when(s % 17 == 0, 0.5).when(s * 53 % 101 < s * 37 % 101, 1.0).otherwise(0.0).alias("payout_yes"),
            F.col("s_acctbal").alias("volume"),
            F.array(F.concat(F.lit("e"), s % 7), F.concat(F.lit("e"), s * 31 % 23 + 7)).alias("events"),
            F.element_at(F.array(*map(F.lit, TIERS)), (s % 3 + 1).cast("int")).alias("tier"),
        )

    @cached_property
    def prints(self) -> DataFrame:
        rows = self.table("lineitem").join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-02").cast("date")).cast("long")
        side = F.when(F.col("l_linestatus") == "O", 0).otherwise(2) + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
        price = F.round((F.col("l_suppkey") * 37 % 101) / 100.0 + (F.col("l_discount") - 0.05) * 0.4, 4)
        return rows.select(
            F.col("l_suppkey").alias("market_id"),
            (F.col("o_custkey") % 60).alias("wallet"),
            (START + day * 3456 + (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 101) % 3456).alias("ts"),
            side.alias("side"),
            F.col("l_quantity").alias("size"),
            F.greatest(F.lit(0.01), F.least(F.lit(0.99), price)).alias("yes_price"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        )

    @cached_property
    def tape(self) -> DataFrame:
        order = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "size", "l_extendedprice"]
        token = F.when(F.col("side").isin(0, 2), F.col("yes_price")).otherwise(F.round(1 - F.col("yes_price"), 4))
        # places are counted inside a market's day, after the days before
        rows = self.kept("prints", self.prints).withColumn("day", F.floor(F.col("ts") / 86400))
        earlier = F.sum("count").over(Window.partitionBy("market_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
        days = rows.groupBy("market_id", "day").count().select("market_id", "day", F.coalesce(earlier, F.lit(0)).alias("before"))
        placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy("market_id", "day").orderBy(*order))).join(days, ["market_id", "day"])
        out = self.kept("tape", placed.select("market_id", "wallet", "ts", "side", "size", "yes_price", token.alias("token_price"), (F.col("before") + F.col("nth")).alias("seq")))
        self.dropped("prints")
        return out

    @cached_property
    def labels(self) -> DataFrame:
        return self.markets.select("market_id", "payout_yes", "event_at", "label_available_at", "tier")

    @cached_property
    def rules(self) -> DataFrame:
        return self.spark.createDataFrame(RULES, RULE_COLUMNS)

    @cached_property
    def cases(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(c.values()) for c in CASES], ", ".join(f"`{c}` {t}" for c, t in CASE_COLUMNS.items()))

    @cached_property
    def account(self) -> DataFrame:
        return self.spark.createDataFrame(ACCOUNT, ", ".join(f"`{c}` {t}" for c, t in ACCOUNT_COLUMNS.items()))

    @cached_property
    def bars(self) -> DataFrame:
        return self.kept("bars", bars.hourly_bars(self.tape).sortWithinPartitions("market_id", "hour"))

    @cached_property
    def dense(self) -> DataFrame:
        return bars.dense_hours(self.bars, END)

    @cached_property
    def rolled(self) -> DataFrame:
        return bars.rolling_bars(self.dense, WIDTH)

    @cached_property
    def activations(self) -> DataFrame:
        return self.kept("activations", bars.activation(self.rolled, self.markets, self.rules))

    @cached_property
    def gate(self) -> DataFrame:
        return self.activations.where(F.col("rule") == CHAIN_RULE)

    @cached_property
    def gated(self) -> DataFrame:
        return self.kept("gated", bars.gate_tape(self.tape, self.gate, self.labels).drop("rule"))

    @cached_property
    def admissions(self) -> DataFrame:
        return bars.volume_admission(self.tape, 1000)

    @cached_property
    def settlements(self) -> DataFrame:
        before = self.tape.join(self.labels.select("market_id", "event_at"), "market_id").where("ts < event_at").select(*self.tape.columns)
        return self.kept("settlements", history.settlements(before, self.labels))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").join(self.markets.select(F.col("market_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("market_id"), F.col("embedding").alias("vector"))

    @cached_property
    def pairs(self) -> DataFrame:
        return vectors.market_pairs(self.vectors, KERNEL)

    @cached_property
    def skills(self) -> DataFrame:
        return skill.skill(self.gated, self.settlements)

    @cached_property
    def observations(self) -> DataFrame:
        return self.kept("observations", signal.observations(self.gated, self.skills))

    @cached_property
    def signals(self) -> DataFrame:
        out = self.kept("signals", signal.consensus(self.observations, CONSENSUS, lambda df: self.kept("flow", df)))
        self.dropped("flow")
        return out

    @cached_property
    def candidates(self) -> DataFrame:
        return signal.entry_candidates(self.signals, self.markets, self.cases)

    @cached_property
    def staked(self) -> DataFrame:
        return self.kept("staked", execution.order_stakes(self.candidates, self.account, execution.observed_notional(self.tape), self.cases))

    @cached_property
    def orders(self) -> DataFrame:
        return self.kept("orders", signal.first_entries(self.staked.where("stake > 0")))

    @cached_property
    def zones(self) -> DataFrame:
        return self.kept("zones", execution.price_zones(self.tape).sortWithinPartitions("market_id", "hour"))

    @cached_property
    def fills(self) -> DataFrame:
        return self.kept("fills", execution.participation_fills(self.orders, self.tape, self.cases, self.zones, lambda df: self.kept("visited", df)))

    @cached_property
    def positions(self) -> DataFrame:
        return self.kept("positions", execution.settle_positions(self.fills, self.labels))

    @cached_property
    def equity(self) -> DataFrame:
        return self.kept("equity", execution.daily_marks(self.fills, self.positions, self.tape, INITIAL))

    @cached_property
    def raw_markets(self) -> DataFrame:
        s = F.col("s_suppkey")

        def stamp(month: int, tail: str):
            return F.concat(F.lit(f"1995-{month:02d}-1"), s % 10, F.lit("T0"), s % 7, F.lit(":30:15"), F.lit(tail))

        prices = F.when(s % 4 == 0, '["1","0"]').when(s % 4 == 1, '["0.005","0.995"]').when(s % 4 == 2, '["0.5","0.5"]').otherwise('["0.7","0.3"]')
        return self.table("supplier").select(
            F.concat(F.lit("m"), s).alias("conditionId"),
            F.concat(F.lit("Will "), "s_name", F.lit(" win?")).alias("question"),
            F.when(s % 11 != 0, stamp(1, "Z")).alias("createdAt"),
            stamp(3, "Z").alias("endDate"),
            F.when(s % 3 == 0, stamp(4, "Z")).alias("resolvedAt"),
            F.when(s % 5 == 0, F.lit("soon")).when(s % 2 == 0, stamp(3, ".500Z")).alias("umaEndDate"),
            F.when(s % 6 == 0, stamp(5, ".250Z")).alias("closedTime"),
            F.lit(None).cast("string").alias("resolveDate"),
            (s % 5 != 1).alias("closed"),
            F.when(s % 7 == 0, "proposed").otherwise("resolved").alias("umaResolutionStatus"),
            F.lit('["Up","Down"]').alias("outcomes"),
            prices.alias("outcomePrices"),
            F.concat(F.lit('["t'), s * 2, F.lit('","t'), s * 2 + 1, F.lit('"]')).alias("clobTokenIds"),
            F.col("s_acctbal").alias("volume"),
        )

    @cached_property
    def raw_trades(self) -> DataFrame:
        k = F.col("l_orderkey") + F.col("l_linenumber")
        index = F.col("side") % 2
        token = F.when(index == 0, F.col("yes_price")).otherwise(F.round(1 - F.col("yes_price"), 4))
        return self.prints.select(
            F.concat(F.lit("m"), "market_id").alias("conditionId"),
            F.when(k % 13 == 0, "x").otherwise(F.concat(F.lit("t"), F.col("market_id") * 2 + index)).alias("asset"),
            F.when(k % 17 == 0, "?").when(index == 0, "Up").otherwise("Down").alias("outcome"),
            F.when(k % 3 == 0, 999).otherwise(index).cast("int").alias("outcomeIndex"),
            F.when(F.col("side") < 2, "BUY").otherwise("SELL").alias("side"),
            F.when(k % 19 == 0, token + 1).otherwise(token).alias("price"),
            F.when(k % 23 == 0, 0.0).otherwise(F.col("size")).alias("size"),
            F.col("ts").alias("timestamp"),
            F.when(k % 29 == 0, "0xbad").otherwise(F.concat(F.lit("0x"), F.lpad(F.col("wallet").cast("string"), 40, "0"))).alias("proxyWallet"),
            F.concat(F.lit("h"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey", F.lit("-"), F.col("size").cast("int"), F.lit("-"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("transactionHash"),
        )

    @cached_property
    def clean_markets(self) -> DataFrame:
        return cleaning.normalize_markets(self.raw_markets)


SQL = [
    """markets AS (
  SELECT s_suppkey AS market_id,
    CASE s_suppkey % 3 WHEN 0 THEN 'Team' || s_suppkey || ' vs. Team' || (s_suppkey + 1)
                       WHEN 1 THEN 'Will ' || s_name || ' win the cup?' ELSE 'Will ' || s_name || ' ship on time?' END AS question,
    'cat' || (s_nationkey % 5) AS category,
    789782400 + (s_suppkey * 7919 % 1000) * 7344 AS event_at,
    789782401 + (s_suppkey * 7919 % 1000) * 7344 AS label_available_at,
    789782400 + (s_suppkey * 7919 % 1000) * 7344 + (s_suppkey % 30) * 86400 AS close_at,
    CASE WHEN s_suppkey % 17 = 0 THEN CAST(0.5 AS DOUBLE) WHEN s_suppkey * 53 % 101 < s_suppkey * 37 % 101 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS payout_yes,
    s_acctbal AS volume, ['e' || (s_suppkey % 7), 'e' || (s_suppkey * 31 % 23 + 7)] AS events, ['metadata_proxy', 'chain_event_observed', 'chain_event_reconstructed'][s_suppkey % 3 + 1] AS tier
  FROM supplier)""",
    """prints AS (
  SELECT l_suppkey AS market_id, o_custkey % 60 AS wallet,
    788918400 + datediff('day', TIMESTAMP '1995-01-02', l_shipdate) * 3456 + (l_orderkey * 7919 + l_linenumber * 101) % 3456 AS ts,
    CASE WHEN l_linestatus = 'O' THEN 0 ELSE 2 END + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS side,
    l_quantity AS size,
    greatest(0.01, least(0.99, round((l_suppkey * 37 % 101) / 100.0 + (l_discount - 0.05) * 0.4, 4))) AS yes_price,
    l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    """tape AS (
  SELECT market_id, wallet, ts, side, size, yes_price, CASE WHEN side IN (0, 2) THEN yes_price ELSE round(1 - yes_price, 4) END AS token_price,
    row_number() OVER (PARTITION BY market_id ORDER BY ts, l_orderkey, l_linenumber, l_partkey, size, l_extendedprice) AS seq
  FROM prints)""",
    values("rules", {"rule": "string", "family": "string", "min_notional": "double", "rolling": "boolean", "min_prints": "int", "warmup_hours": "int", "min_conviction": "double", "max_days": "double"}, RULES),
    values("cases", CASE_COLUMNS, [tuple(c.values()) for c in CASES]),
    values("account", ACCOUNT_COLUMNS, ACCOUNT),
    """bars AS (
  SELECT market_id, ts // 3600 AS hour, sum(size) AS quantity, sum(size * yes_price) AS price_quantity, sum(size * token_price) AS dollars, count(*) AS prints, min(ts) AS first_ts
  FROM tape GROUP BY ALL)""",
    f"""dense AS (
  SELECT g.market_id, g.hour, coalesce(quantity, 0) AS quantity, coalesce(price_quantity, 0) AS price_quantity, coalesce(dollars, 0) AS dollars, coalesce(prints, 0) AS prints, first_ts
  FROM (SELECT market_id, unnest(range(min(hour), {END // 3600})) AS hour FROM bars GROUP BY market_id) g LEFT JOIN bars b ON g.market_id = b.market_id AND g.hour = b.hour)""",
    f"""rolled AS (
  SELECT *, CASE WHEN recent_quantity > 0 THEN recent_pq / recent_quantity ELSE 0.5 END AS recent_yes_vwap FROM (
  SELECT *, sum(quantity) OVER r AS recent_quantity, sum(price_quantity) OVER r AS recent_pq, sum(dollars) OVER r AS recent_notional, CAST(sum(prints) OVER r AS BIGINT) AS recent_prints,
    sum(dollars) OVER c AS cumulative_notional, min(first_ts) OVER c AS first_print
  FROM dense WINDOW r AS (PARTITION BY market_id ORDER BY hour RANGE BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW), c AS (PARTITION BY market_id ORDER BY hour ROWS UNBOUNDED PRECEDING)))""",
    """met AS (
  SELECT r.*, u.rule, (hour + 1) * 3600 AS time, ((hour + 1) * 3600 - first_print) / 3600 AS observed_hours,
    row_number() OVER (PARTITION BY r.market_id, u.rule ORDER BY hour) AS k
  FROM rolled r JOIN markets m ON r.market_id = m.market_id, rules u
  WHERE (hour + 1) * 3600 - first_print >= warmup_hours * 3600 AND round(CASE WHEN rolling THEN recent_notional ELSE cumulative_notional END, 4) >= min_notional
    AND recent_prints >= min_prints AND round(greatest(recent_yes_vwap, 1 - recent_yes_vwap), 9) >= min_conviction
    AND (max_days IS NULL OR (close_at > (hour + 1) * 3600 AND close_at - (hour + 1) * 3600 < max_days * 86400)))""",
    "activations AS (SELECT market_id, rule, time, cumulative_notional, recent_notional, recent_prints, recent_yes_vwap, observed_hours FROM met WHERE k = 1)",
    f"gate AS (SELECT * FROM activations WHERE rule = '{CHAIN_RULE}')",
    "gated AS (SELECT t.* FROM tape t JOIN gate g ON t.market_id = g.market_id JOIN markets m ON t.market_id = m.market_id WHERE t.ts >= g.time AND t.ts < m.label_available_at)",
    """admissions AS (
  SELECT market_id, min(ts) + 1 AS admitted_at, arg_min(c, ts) AS cumulative FROM (
    SELECT market_id, ts, sum(d) OVER (PARTITION BY market_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM (
      SELECT market_id, ts, sum(CAST(size * token_price AS DECIMAL(18,4))) AS d FROM tape GROUP BY ALL)) WHERE c >= 1000 GROUP BY market_id)""",
    """settlements AS (
  SELECT wallet, market_id, greatest(-1, least(1, (shares * payout_yes - paid) / notional)) AS score, notional, label_available_at AS settled_at FROM (
    SELECT wallet, t.market_id, sum(CASE WHEN side IN (0, 3) THEN size ELSE -size END) AS shares, sum(CASE WHEN side IN (0, 3) THEN size ELSE -size END * yes_price) AS paid,
      sum(size * token_price) AS notional, any_value(payout_yes) AS payout_yes, any_value(label_available_at) AS label_available_at
    FROM tape t JOIN markets m ON t.market_id = m.market_id WHERE ts < event_at GROUP BY wallet, t.market_id) WHERE notional > 0)""",
    f"""pairs AS (
  SELECT target, other, cosine, (cosine - {KERNEL}) / (1 - {KERNEL}) AS weight FROM (
    SELECT a.vec_id AS target, b.vec_id AS other, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT market_id FROM markets) AND b.vec_id IN (SELECT market_id FROM markets)) WHERE cosine > {KERNEL})""",
]


def skill_sql(name: str, weight: str = "s.notional", joins: str = "", only: str = "TRUE", total: str = "sum(s.notional)") -> str:
    """The seven statistics by the naive join of each gated trade with its wallet's visible settlements."""
    return f"""{name} AS (
  SELECT market_id, seq, wallet, CASE WHEN o THEN ws / w ELSE 0 END AS weighted_score, CASE WHEN o THEN w ELSE 0 END AS weighted_history_notional, CAST(CASE WHEN o THEN n ELSE 0 END AS BIGINT) AS supporting_markets,
    CASE WHEN o THEN w * w / w2 ELSE 0 END AS effective_history_markets, CASE WHEN o THEN w / total ELSE 0 END AS mean_similarity, CASE WHEN o THEN wpos / w ELSE 0 END AS positive_history_weight_fraction,
    CASE WHEN o THEN sqrt(greatest(0, ws2 / w - (ws / w) * (ws / w))) ELSE 0 END AS weighted_score_std
  FROM (SELECT *, coalesce(n > 0 AND w > 0, FALSE) AS o FROM (
    SELECT t.market_id, t.seq, t.wallet, count(*) FILTER (x > 0) AS n, sum(x) AS w, sum(x * x) AS w2, sum(x * score) AS ws, sum(x * score * score) AS ws2, coalesce(sum(x) FILTER (score > 0), 0) AS wpos, sum(notional) AS total
    FROM gated t LEFT JOIN (SELECT t.market_id, t.seq, s.score, s.notional, CASE WHEN {only} THEN {weight} ELSE 0 END AS x FROM gated t JOIN settlements s ON t.wallet = s.wallet AND s.settled_at <= t.ts AND s.market_id <> t.market_id {joins}) v
      ON t.market_id = v.market_id AND t.seq = v.seq GROUP BY ALL)))"""


DIRECTION = "CASE WHEN side IN (0, 3) THEN 'YES' ELSE 'NO' END"
PRICE_FOR = "CASE WHEN {d} = 'YES' THEN yes_price ELSE round(1 - yes_price, 4) END"
DIAG = {"mean_history_markets": "effective_history_markets", "mean_similarity_seen": "mean_similarity", "mean_positive_fraction": "positive_history_weight_fraction", "mean_score_std": "skill_score_std"}


def decision_sql(name: str, rows: str, keep: str) -> str:
    """The decision columns over rows with yes, no, wallets, largest and per direction sums."""
    c = CONSENSUS
    diag = ", ".join(f"CASE WHEN direction = 'YES' THEN {n}_yes / yes WHEN direction = 'NO' THEN {n}_no / no ELSE 0 END AS {n}" for n in DIAG)
    keep = f"{keep}, " if keep else ""
    return f"""{name} AS (
  SELECT {keep}coalesce(direction IS NOT NULL AND directional_wallets >= {c.min_directional_wallets} AND round(effective_wallets, 9) >= {c.min_effective_wallets} AND round(directional_share, 9) <= {c.max_directional_share}, FALSE) AS should_trade,
    direction, confidence, total_weight, skilled_wallets, wallet_share, directional_wallets, effective_wallets, directional_share, {", ".join(DIAG)}
  FROM (SELECT *, CASE WHEN nope OR wallet_share > {c.max_wallet_share} THEN 0 WHEN direction = 'YES' THEN yes / total_weight WHEN direction = 'NO' THEN no / total_weight ELSE greatest(yes, no) / total_weight END AS confidence,
      CAST(CASE direction WHEN 'YES' THEN wallets_yes WHEN 'NO' THEN wallets_no ELSE 0 END AS BIGINT) AS directional_wallets,
      CASE direction WHEN 'YES' THEN yes * yes / squares_yes WHEN 'NO' THEN no * no / squares_no ELSE 0 END AS effective_wallets,
      CASE direction WHEN 'YES' THEN largest_yes / yes WHEN 'NO' THEN largest_no / no ELSE 0 END AS directional_share, {diag}
    FROM (SELECT *, CASE WHEN nope OR wallet_share > {c.max_wallet_share} THEN NULL WHEN yes / (yes + no) >= {c.consensus_threshold} THEN 'YES' WHEN no / (yes + no) >= {c.consensus_threshold} THEN 'NO' END AS direction
      FROM (SELECT *, CAST(wallets AS BIGINT) AS skilled_wallets, wallets < {max(1, c.min_wallets)} OR yes + no <= 0 AS nope,
          CASE WHEN wallets < {max(1, c.min_wallets)} OR yes + no <= 0 THEN 0 ELSE yes + no END AS total_weight, CASE WHEN wallets < {max(1, c.min_wallets)} OR yes + no <= 0 THEN 0 ELSE largest / (yes + no) END AS wallet_share
        FROM ({rows})))))"""


def flow_sums(inner: str, outer: str, source: str) -> str:
    """Sums of the qualifying observations o per wallet, then over wallets, for each key."""
    total = ", ".join(f"coalesce(sum({n}_{d}), 0) AS {n}_{d}" for n in DIAG for d in ("yes", "no"))
    each = ", ".join(f"sum(o.w * o.{c}) FILTER (o.direction = '{d.upper()}') AS {n}_{d}" for n, c in DIAG.items() for d in ("yes", "no"))
    return f"""SELECT {outer}, count(*) FILTER (wallet IS NOT NULL) AS wallets, coalesce(max(cy + cn), 0) AS largest, coalesce(sum(cy), 0) AS yes, coalesce(sum(cn), 0) AS no,
      count(*) FILTER (ky > 0) AS wallets_yes, count(*) FILTER (kn > 0) AS wallets_no, coalesce(sum(cy * cy), 0) AS squares_yes, coalesce(sum(cn * cn), 0) AS squares_no, coalesce(max(cy), 0) AS largest_yes, coalesce(max(cn), 0) AS largest_no, {total}
    FROM (SELECT {inner}, o.wallet, coalesce(sum(o.w) FILTER (o.direction = 'YES'), 0) AS cy, coalesce(sum(o.w) FILTER (o.direction = 'NO'), 0) AS cn, count(*) FILTER (o.direction = 'YES') AS ky, count(*) FILTER (o.direction = 'NO') AS kn, {each} FROM {source} GROUP BY {inner}, o.wallet) GROUP BY {outer}"""


AT = ("r.market_id, r.seq, r.ts, r.yes_price", "market_id, seq, ts, yes_price")
SQL += [
    skill_sql("skills"),
    f"""observations AS (
  SELECT t.market_id, t.seq, t.ts, t.wallet, t.yes_price, {DIRECTION} AS direction, CAST(size AS DOUBLE) AS volume, weighted_score AS skill, weighted_history_notional, supporting_markets, effective_history_markets, mean_similarity, positive_history_weight_fraction, weighted_score_std AS skill_score_std
  FROM gated t JOIN skills k ON t.market_id = k.market_id AND t.seq = k.seq)""",
    f"flow AS (SELECT *, skill * volume AS w FROM observations WHERE skill >= {CONSENSUS.skill_threshold} AND volume > 0)",
    decision_sql("signals", flow_sums(*AT, "observations r LEFT JOIN flow o ON o.market_id = r.market_id AND o.seq <= r.seq"), AT[1]),
    """candidates AS (
  SELECT "case", market_id, seq, ts, direction, confidence, price, allowed_price, bucket, wait_days, question FROM (
    SELECT *, round(least(max_price, CASE WHEN high_confidence <= consensus THEN price_low ELSE price_low + (greatest(consensus, least(high_confidence, confidence)) - consensus) / (high_confidence - consensus) * (price_high - price_low) END), 9) AS allowed_price,
      CASE WHEN price > stable_floor THEN 'stable' WHEN price BETWEEN lottery_low AND lottery_high THEN 'lottery' END AS bucket, coalesce(planning_days * 86400, close_at - ts) / 86400 AS wait_days
    FROM (SELECT s.*, m.close_at, m.question, c.*, CASE WHEN s.direction = 'YES' THEN yes_price ELSE round(1 - yes_price, 4) END AS price FROM signals s JOIN markets m ON s.market_id = m.market_id, cases c WHERE should_trade AND direction IS NOT NULL))
  WHERE (entry_start IS NULL OR ts >= entry_start) AND (entry_end IS NULL OR ts <= entry_end) AND mean_history_markets >= min_history AND price BETWEEN min_price AND max_price
    AND round(confidence - price, 9) >= min_edge AND price <= allowed_price AND bucket IS NOT NULL AND wait_days > min_days AND wait_days < max_days)""",
    "observed AS (SELECT market_id, seq, sum(size * token_price) OVER (PARTITION BY market_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS observed_notional FROM tape)",
    """staked AS (
  SELECT "case", market_id, seq, ts, direction, confidence, price, allowed_price, bucket, wait_days, question, CASE WHEN bucket = 'lottery' THEN lottery_lot END AS quantity,
    CASE WHEN bucket = 'lottery' THEN CASE WHEN lottery_max_fraction > 0 AND round(lottery_open + lottery_lot * price, 9) <= round(cash * lottery_max_fraction, 9) THEN lottery_lot * price ELSE 0 END WHEN stake >= min_ticket THEN stake ELSE 0 END AS stake FROM (
    SELECT e.*, c.min_ticket, c.lottery_lot, c.lottery_max_fraction, a.cash, a.lottery_open, least(
        greatest(0, equity * target_fraction - deployed) * greatest(min_fraction, least(max_fraction, greatest(0, confidence - price) * 365 / greatest(wait_days, 1e-9) * edge_multiplier)),
        greatest(0, cash - equity * buffer_fraction), equity * max_position_fraction,
        CASE WHEN (regexp_matches(trim(question), '\\bvs\\.?\\b', 'i') AND NOT suffix(trim(question), '?')) OR regexp_matches(question, '\\b(win|winner|champion|qualify|make|reach)\\b', 'i') AND regexp_matches(question, '\\b(finals?|championship|cup|tournament|super bowl|world series|playoffs?)\\b', 'i') THEN equity * max_competitive_fraction ELSE 1e300 END,
        coalesce(observed_notional, 0) * max_market_fraction, cash * max_balance_fraction, cash * max_loss_fraction) AS stake
    FROM candidates e JOIN account a ON e."case" = a."case" JOIN cases c ON e."case" = c."case" LEFT JOIN observed o ON e.market_id = o.market_id AND e.seq = o.seq))""",
    'orders_ AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY "case", market_id ORDER BY ts, seq) AS k FROM staked WHERE stake > 0) WHERE k = 1)',
    """later AS (
  SELECT o."case", o.market_id, o.direction, o.seq AS o_seq, o.ts AS o_ts, round(least(1, o.price * (1 + slippage_bps / 10000)), 9) AS o_paid, o.allowed_price, o.stake, o.quantity AS lot, o.bucket, c.* EXCLUDE ("case"), t.seq, t.ts, t.size, t.side,
    round(least(1, greatest(0, CASE WHEN o.direction = 'YES' THEN t.yes_price ELSE round(1 - t.yes_price, 4) END * (1 + slippage_bps / 10000))), 9) AS fill_price
  FROM orders_ o JOIN cases c ON o."case" = c."case" JOIN tape t ON o.market_id = t.market_id AND t.seq > o.seq AND t.ts >= o.ts + delay AND (expiry IS NULL OR t.ts <= o.ts + delay + expiry)
  WHERE CASE trade_filter WHEN 'any' THEN TRUE WHEN 'signal_direction' THEN CASE WHEN t.side IN (0, 3) THEN 'YES' ELSE 'NO' END = o.direction WHEN 'target_token' THEN CASE WHEN o.direction = 'YES' THEN t.side IN (0, 2) ELSE t.side IN (1, 3) END END)""",
    """fit AS (
  SELECT *, row_number() OVER (PARTITION BY "case", market_id ORDER BY seq) AS nth FROM (
    SELECT *, bool_or(kills) OVER (PARTITION BY "case", market_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS dead FROM (
      SELECT *, low OR (high AND NOT wait) OR (NOT low AND NOT high AND gone) AS kills, NOT low AND NOT high AND NOT gone AS fits FROM (
        SELECT *, fill_price <= 0 OR fill_price < min_price AS low, fill_price > max_price OR fill_price > allowed_price OR coalesce(fill_price > round(o_paid * (1 + max_drift_bps / 10000), 9), FALSE) AS high,
          (bucket = 'stable' AND fill_price <= stable_floor) OR (bucket = 'lottery' AND fill_price >= lottery_high) AS gone FROM later))) WHERE fits AND NOT dead)""",
    """children AS (
  SELECT *, nth - confirmations + 1 AS child, size * fill_price * participation AS capacity, stake - coalesce(sum(coalesce(size * fill_price * participation, stake)) OVER (PARTITION BY "case", market_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM fit WHERE nth >= confirmations)""",
    """fills AS (
  SELECT "case", market_id, direction, CAST(child AS INT) AS child, seq, o_ts AS signal_time, ts AS filled_at, fill_price, paid AS notional, paid / fill_price AS quantity, paid * fee_bps / 10000 AS fee, o_paid AS signal_price, size AS source_size, side AS source_side
  FROM (SELECT *, CASE WHEN lot IS NOT NULL THEN lot * fill_price ELSE least(rest, coalesce(capacity, stake)) END AS paid FROM children WHERE child <= max_children AND (child = 1 OR lot IS NULL AND round(rest, 9) >= min_ticket AND rest > 0)))""",
    """positions AS (
  SELECT "case", market_id, direction, quantity, notional / quantity AS avg_price, notional, fee, opened_at, resolved_at, quantity * pays AS payout, quantity * pays - notional AS pnl FROM (
    SELECT "case", f.market_id, direction, sum(quantity) AS quantity, sum(notional) AS notional, sum(fee) AS fee, min(filled_at) AS opened_at, any_value(label_available_at) AS resolved_at, any_value(CASE WHEN direction = 'YES' THEN payout_yes ELSE 1 - payout_yes END) AS pays
    FROM fills f JOIN markets m ON f.market_id = m.market_id WHERE filled_at < label_available_at GROUP BY "case", f.market_id, direction))""",
    """moves AS (
  SELECT "case", market_id, direction, filled_at // 86400 AS day, quantity, notional, -notional - fee AS cash FROM fills
  UNION ALL SELECT "case", market_id, direction, resolved_at // 86400, -quantity, -notional, payout FROM positions WHERE payout IS NOT NULL)""",
    f"""equity AS (
  SELECT "case", day, {INITIAL} + sum(cash) AS cash, sum(CASE WHEN quantity > 1e-9 THEN notional ELSE 0 END) AS open_notional, sum(CASE WHEN quantity > 1e-9 THEN quantity * CASE WHEN direction = 'YES' THEN p ELSE round(1 - p, 4) END ELSE 0 END) AS open_value,
    sum(CASE WHEN quantity > 1e-9 THEN quantity * CASE WHEN direction = 'YES' THEN p ELSE round(1 - p, 4) END ELSE 0 END) - sum(CASE WHEN quantity > 1e-9 THEN notional ELSE 0 END) AS unrealized,
    {INITIAL} + sum(cash) + sum(CASE WHEN quantity > 1e-9 THEN quantity * CASE WHEN direction = 'YES' THEN p ELSE round(1 - p, 4) END ELSE 0 END) AS equity
  FROM (SELECT d."case", d.day, m.market_id, m.direction, sum(m.quantity) AS quantity, sum(m.notional) AS notional, sum(m.cash) AS cash,
      (SELECT arg_max(yes_price, t.ts * 1000000 + t.seq) FROM tape t WHERE t.market_id = m.market_id AND t.ts // 86400 <= d.day) AS p
    FROM (SELECT DISTINCT "case", day FROM moves) d JOIN moves m ON d."case" = m."case" AND m.day <= d.day GROUP BY d."case", d.day, m.market_id, m.direction) GROUP BY "case", day)""",
    """raw_markets AS (
  SELECT 'm' || s AS conditionId, 'Will ' || s_name || ' win?' AS question, CASE WHEN s % 11 <> 0 THEN '1995-01-1' || tail || 'Z' END AS createdAt, '1995-03-1' || tail || 'Z' AS endDate,
    CASE WHEN s % 3 = 0 THEN '1995-04-1' || tail || 'Z' END AS resolvedAt, CASE WHEN s % 5 = 0 THEN 'soon' WHEN s % 2 = 0 THEN '1995-03-1' || tail || '.500Z' END AS umaEndDate,
    CASE WHEN s % 6 = 0 THEN '1995-05-1' || tail || '.250Z' END AS closedTime, CAST(NULL AS VARCHAR) AS resolveDate, s % 5 <> 1 AS closed, CASE WHEN s % 7 = 0 THEN 'proposed' ELSE 'resolved' END AS umaResolutionStatus,
    CASE s % 4 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN 0 WHEN 2 THEN 0.5 END AS end_payout, 't' || (s * 2) AS token0, 't' || (s * 2 + 1) AS token1, s_acctbal AS volume, s
  FROM (SELECT s_suppkey AS s, s_name, s_acctbal, (s_suppkey % 10) || 'T0' || (s_suppkey % 7) || ':30:15' AS tail FROM supplier))""",
    """raw_trades AS (
  SELECT 'm' || market_id AS conditionId, CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN 'x' ELSE 't' || (market_id * 2 + side % 2) END AS asset,
    CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN '?' WHEN side % 2 = 0 THEN 'Up' ELSE 'Down' END AS outcome, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 999 ELSE side % 2 END AS outcomeIndex,
    CASE WHEN side < 2 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN side % 2 = 0 THEN yes_price ELSE round(1 - yes_price, 4) END + CASE WHEN (l_orderkey + l_linenumber) % 19 = 0 THEN 1 ELSE 0 END AS price,
    CASE WHEN (l_orderkey + l_linenumber) % 23 = 0 THEN 0 ELSE size END AS size, ts AS "timestamp", CASE WHEN (l_orderkey + l_linenumber) % 29 = 0 THEN '0xbad' ELSE '0x' || lpad(CAST(wallet AS VARCHAR), 40, '0') END AS proxyWallet,
    'h' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || CAST(size AS INT) || '-' || CAST(l_extendedprice AS DECIMAL(18,2)) AS transactionHash
  FROM prints)""",
    """corrected AS (
  SELECT r.conditionId AS market_id, proxyWallet AS wallet, "timestamp" AS ts, CAST(i + CASE WHEN r.side = 'SELL' THEN 2 ELSE 0 END AS INT) AS side, size, price AS token_price, CASE WHEN i = 0 THEN price ELSE round(1 - price, 9) END AS yes_price,
    outcomeIndex <> i AS corrected, transactionHash AS transaction_hash
  FROM raw_trades r JOIN (SELECT conditionId, token0 AS asset, 0 AS i FROM raw_markets UNION ALL SELECT conditionId, token1, 1 FROM raw_markets) k ON r.conditionId = k.conditionId AND r.asset = k.asset)""",
    """clean_markets AS (
  SELECT conditionId AS market_id, question, CAST(replace(createdAt, 'Z', '') AS TIMESTAMP) AS created_at, CAST(replace(endDate, 'Z', '') AS TIMESTAMP) AS close_time,
    greatest(try_cast(replace(umaEndDate, 'Z', '') AS TIMESTAMP), try_cast(replace(closedTime, 'Z', '') AS TIMESTAMP), try_cast(replace(resolvedAt, 'Z', '') AS TIMESTAMP)) AS resolved_at,
    CASE WHEN closed AND end_payout = 1 THEN 'YES' WHEN closed AND end_payout = 0 THEN 'NO' END AS resolution, volume, NOT closed AS active, token0, token1 FROM raw_markets)""",
]


def oracle(select: str, *more: str) -> str:
    """A query over the common tables, which come first; more: further ones, after them."""
    return "WITH " + ",\n".join([*SQL, *more]) + "\n" + select
