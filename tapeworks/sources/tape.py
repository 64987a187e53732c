"""Reading tapes and writing case outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKETS = "market_id string, question string, category string, created_at timestamp, close_time timestamp, resolved_at timestamp, resolution string, volume double, active boolean, outcome_labels array<string>, clob_token_ids array<string>"
TAPE = "market_id string, wallet string, ts long, side tinyint, size double, yes_price double, token_price double, seq long"
LABELS = "market_id string, payout_yes double, event_at long, label_available_at long, tier string"
VECTORS = "market_id string, vector array<float>"
RAW_TRADES = "conditionId string, asset string, outcome string, outcomeIndex int, side string, price double, size double, timestamp long, proxyWallet string, transactionHash string"
RAW_MARKETS = "conditionId string, question string, createdAt string, endDate string, resolvedAt string, umaEndDate string, closedTime string, resolveDate string, closed boolean, umaResolutionStatus string, outcomes string, outcomePrices string, clobTokenIds string, volume double"


def read_tape(spark: SparkSession, path: str, schema: str = TAPE, kind: str = "parquet") -> DataFrame:
    """A table by an explicit schema: parquet, or json lines (gzip too); columns that are missing are null."""
    return spark.read.schema(schema).format(kind).load(path)


def load_inputs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """markets (JSON lines, gzip too), tape, labels and vectors (parquet) of a prepared archive, each by its schema."""
    root = root.rstrip("/")
    return {"markets": read_tape(spark, f"{root}/markets", MARKETS, "json")} | {name: read_tape(spark, f"{root}/{name}", schema) for name, schema in (("tape", TAPE), ("labels", LABELS), ("vectors", VECTORS))}


def inventory(inputs: dict[str, DataFrame]) -> DataFrame:
    """(market_id, problem): where the parts of an archive do not agree, or hold impossible values.

    Vectors must be there once for each market and for no other, finite and of the width that most
    have; a label must be available after its event, with a payout in [0, 1].
    """
    markets, labels, vectors = inputs["markets"].select("market_id"), inputs["labels"], inputs["vectors"].withColumn("width", F.size("vector"))
    usual = vectors.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).select(F.col("width").alias("usual"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def named(df: DataFrame, problem: str) -> DataFrame:
        return df.select("market_id", F.lit(problem).alias("problem"))

    found = [
        named(markets.groupBy("market_id").count().where("count > 1"), "market_repeated"),
        named(markets.join(vectors, "market_id", "left_anti"), "vector_missing"),
        named(vectors.join(markets, "market_id", "left_anti"), "vector_of_no_market"),
        named(vectors.groupBy("market_id").count().where("count > 1"), "vector_repeated"),
        named(vectors.where(~F.coalesce(finite, F.lit(False))), "vector_not_finite"),
        named(vectors.crossJoin(usual).where("width != usual"), "vector_width"),
        named(labels.where("not (label_available_at > event_at)"), "label_time"),
        named(labels.where("payout_yes is not null and not payout_yes between 0 and 1"), "label_payout"),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def write_bucketed(tape: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Stores a tape as a table in buckets by market, each sorted by market and seq, and its manifest beside it; the manifest is returned.

    Joins and aggregations by market of tables with as many buckets then need no shuffle of the
    tape (`bucketed` reads one). A market lies in one bucket, so this is for tapes whose hottest market fits a
    task; others keep the plain layout, whose joins adaptive execution splits. The manifest has
    market_id, bucket, rows, first_ts, last_ts, first_seq and last_seq. Never over an old table.
    """
    path = path.rstrip("/")
    # a task writes whole buckets: the shuffle's hash is that of the buckets
    dealt = tape.repartition(buckets, "market_id")
    dealt.write.mode("errorifexists").format("parquet").bucketBy(buckets, "market_id").sortBy("market_id", "seq").option("path", f"{path}/tape").saveAsTable(table)
    stored = tape.sparkSession.table(table)
    bucket = F.pmod(F.hash("market_id"), F.lit(buckets)).alias("bucket")
    manifest = stored.groupBy("market_id").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    manifest.select("market_id", bucket, "rows", "first_ts", "last_ts", "first_seq", "last_seq").write.mode("errorifexists").parquet(f"{path}/manifest")
    return tape.sparkSession.read.parquet(f"{path}/manifest")


def bucketed(spark: SparkSession, table: str) -> DataFrame:
    """A tape that `write_bucketed` stored. Joins on more columns than the market use its buckets if spark.sql.requireAllClusterKeysForCoPartition is false."""
    return spark.table(table)


def write_case_outputs(df: DataFrame, path: str, name: str, kind: str = "parquet") -> str:
    """Writes a result table below path, in a folder for each case; never over an old one."""
    to = f"{path.rstrip('/')}/{name}"
    df.write.mode("errorifexists").partitionBy("case").format(kind).save(to)
    return to
