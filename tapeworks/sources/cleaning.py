"""From raw markets and trades to a clean tape with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The date fields that can say when a market was resolved, in the order in which their issues are listed; the prices that settle one; the names of issues and tiers below.
RESOLUTION_DATES = ("resolvedAt", "umaEndDate", "closedTime", "resolveDate")
WON, LOST = 0.99, 0.01
WALLET = r"^0x[0-9a-fA-F]{40}$"
#: Prints of a market whose order is checked together.
RUN_LOG2 = 16


def _array(column: str) -> Column:
    return F.from_json(F.col(column), "array<string>")


def _time(column: str) -> Column:
    return F.try_to_timestamp(F.col(column))


def _epoch(column: str) -> Column:
    """Seconds since the epoch, a part of a second counting as a whole one."""
    return F.ceil(F.unix_micros(_time(column)) / 1000000).cast("long")


def _payout() -> Column:
    p = [F.try_element_at(_array("outcomePrices"), F.lit(i)).try_cast("double") for i in (1, 2)]
    return F.when((p[0] >= WON) & (p[1] <= LOST), 1.0).when((p[1] >= WON) & (p[0] <= LOST), 0.0).when((F.abs(p[0] - 0.5) < 1e-12) & (F.abs(p[1] - 0.5) < 1e-12), 0.5)


def normalize_markets(raw: DataFrame) -> DataFrame:
    """Typed markets: lists from JSON strings, times, YES or NO if closed at an end price, resolved_at the last of the claimed dates."""
    payout = _payout()
    return raw.select(
        F.col("conditionId").alias("market_id"),
        "question",
        _time("createdAt").alias("created_at"),
        _time("endDate").alias("close_time"),
        F.greatest(*[_time(c) for c in RESOLUTION_DATES]).alias("resolved_at"),
        F.when(F.col("closed") & (payout == 1.0), "YES").when(F.col("closed") & (payout == 0.0), "NO").alias("resolution"),
        F.col("volume").cast("double").alias("volume"),
        (~F.coalesce("closed", F.lit(False))).alias("active"),
        _array("outcomes").alias("outcome_labels"),
        _array("clobTokenIds").alias("clob_token_ids"),
    )


def token_map(markets: DataFrame) -> DataFrame:
    """(market_id, asset, token_index) of each market's tokens."""
    return markets.select("market_id", F.posexplode("clob_token_ids").alias("token_index", "asset"))


def normalize_trades(raw: DataFrame, markets: DataFrame) -> DataFrame:
    """Tape rows of raw trades: the outcome by index 0 or 1, else by token, else by label; side and price null if none tells.

    The price of a NO token is complemented and clamped to [0, 1]; a true zero stays zero.
    """
    tokens = token_map(markets).withColumnRenamed("market_id", "conditionId")
    labels = markets.select(F.col("market_id").alias("conditionId"), "outcome_labels")
    rows = raw.join(tokens, ["conditionId", "asset"], "left").join(labels, "conditionId", "left")
    by_label = F.array_position(F.transform("outcome_labels", F.lower), F.lower("outcome")) - 1
    by_text = F.when(F.lower("outcome") == "yes", 0).when(F.lower("outcome") == "no", 1)
    index = F.coalesce(F.when(F.col("outcomeIndex").isin(0, 1), F.col("outcomeIndex")), F.col("token_index"), F.when(by_label >= 0, by_label.cast("int")), by_text)
    price = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("price")))
    side = (index + F.when(F.upper("side") == "SELL", 2).otherwise(0)).cast("int")
    return rows.select(F.col("conditionId").alias("market_id"), F.col("proxyWallet").alias("wallet"), F.col("timestamp").alias("ts"), side.alias("side"), "size", F.when(index == 0, price).when(index == 1, F.round(1 - price, 9)).alias("yes_price"), F.col("transactionHash").alias("transaction_hash"))


def corrected_trades(raw: DataFrame, markets: DataFrame) -> DataFrame:
    """The strict version: the token decides, rows of unknown tokens go; corrected tells an index that said otherwise."""
    rows = raw.join(token_map(markets).withColumnRenamed("market_id", "conditionId"), ["conditionId", "asset"])
    index = F.col("token_index")
    return rows.select(
        F.col("conditionId").alias("market_id"),
        F.col("proxyWallet").alias("wallet"),
        F.col("timestamp").alias("ts"),
        (index + F.when(F.upper("side") == "SELL", 2).otherwise(0)).cast("int").alias("side"),
        "size",
        F.col("price").alias("token_price"),
        F.when(index == 0, F.col("price")).otherwise(F.round(1 - F.col("price"), 9)).alias("yes_price"),
        F.coalesce(F.col("outcomeIndex") != index, F.lit(True)).alias("corrected"),
        F.col("transactionHash").alias("transaction_hash"),
    )


def quarantine_reason(price: str = "token_price") -> Column:
    """Why a row is not valid, or null."""
    p = F.col(price)
    return (
        F.when(p.isNull() | F.isnan(p) | ~p.between(0, 1), "bad_price")
        .when(F.col("size").isNull() | F.isnan("size") | (F.col("size") <= 0) | (F.abs("size") == float("inf")), "bad_size")
        .when(~F.coalesce(F.rlike("wallet", F.lit(WALLET)), F.lit(False)), "bad_wallet")
    )


def quarantine(trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with reason)."""
    marked = trades.withColumn("reason", quarantine_reason())
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def select_page_rows(rows: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of overlapping pages (page_id, ts, ...) inside their page's [min_time, max_time]; and per page the count against expected."""
    kept = rows.join(manifest, "page_id").where(F.col("ts").between(F.col("min_time"), F.col("max_time"))).select(*rows.columns)
    counts = kept.groupBy("page_id").agg(F.count("*").alias("rows"))
    checks = manifest.join(counts, "page_id", "left").fillna(0, ["rows"]).withColumn("ok", F.col("rows") == F.col("expected"))
    return kept, checks.select("page_id", "rows", "expected", "ok")


def dedup_trades(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row, by order, of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def merge_sources(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both caches; in their overlap in time (ts), an old row goes if new has its key."""
    span = new.agg(F.min("ts").alias("from_ts")).crossJoin(old.agg(F.max("ts").alias("to_ts")))
    overlap = new.crossJoin(F.broadcast(span)).where(F.col("ts") <= F.col("to_ts")).select(*keys).distinct()
    marked = old.crossJoin(F.broadcast(span))
    inside = F.col("ts") >= F.col("from_ts")
    kept = marked.where(F.coalesce(~inside, F.lit(True))).select(*old.columns).unionByName(marked.where(inside).select(*old.columns).join(overlap, keys, "left_anti"))
    return kept.unionByName(new)


def top_markets(markets: DataFrame, n: int) -> DataFrame:
    """The n markets of largest volume that have an id and a creation date, with their rank."""
    rows = markets.where("market_id is not null and created_at is not null").orderBy(F.desc("volume"), "market_id").limit(n)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("volume"), "market_id")))


def last_trade_adjust(markets: DataFrame, tape: DataFrame) -> DataFrame:
    """Markets whose resolved_at (seconds) is before their last print get the second after that print."""
    last = tape.groupBy("market_id").agg(F.max("ts").alias("__last"))
    out = markets.join(last, "market_id", "left")
    late = F.col("resolved_at") <= F.col("__last")
    return out.withColumn("adjusted", F.coalesce(late, F.lit(False))).withColumn("resolved_at", F.when(late, F.col("__last") + 1).otherwise(F.col("resolved_at"))).drop("__last")


def eligible_trades(tape: DataFrame, markets: DataFrame, max_days: float, start: int, end: int) -> DataFrame:
    """Prints in [start, end] whose market closes after them, within max_days (both strict)."""
    rows = tape.where(F.col("ts").between(start, end)).join(markets.select("market_id", "close_at"), "market_id")
    wait = F.col("close_at") - F.col("ts")
    return rows.where((wait > 0) & (wait < max_days * 86400)).select(*tape.columns)


def truncation_filter(tape: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(the tape without markets whose rows reach the download cap, those markets with their counts)."""
    capped = tape.groupBy("market_id").agg(F.count("*").alias("rows")).where(F.col("rows") >= cap)
    return tape.join(capped.select("market_id"), "market_id", "left_anti"), capped


def resolution_evidence(raw: DataFrame, observed_at: int) -> DataFrame:
    """(market_id, payout_yes, event_at, label_available_at, tier, issues): labels from metadata, unusable if anything speaks against one.

    event_at is the last claimed date, a part of a second counting as a whole one; the label is
    available a second later.
    """
    event = F.greatest(*[_epoch(c) for c in RESOLUTION_DATES])
    names, prices = _array("outcomes"), _array("outcomePrices")
    numbers = F.transform(prices, lambda x: x.try_cast("double"))
    structure = (F.size(names) == 2) & (F.size(F.array_distinct(names)) == 2) & (F.size(prices) == 2) & F.forall(numbers, lambda x: F.coalesce(x.between(0, 1), F.lit(False)))
    unparsed = names.isNull() | prices.isNull() | F.exists(numbers, lambda x: x.isNull())
    payout = _payout()
    tests = [
        *[(F.col(c).isNotNull() & (F.col(c) != "") & _time(c).isNull(), f"invalid_resolution_date:{c}") for c in RESOLUTION_DATES],
        (~F.coalesce("closed", F.lit(False)), "not_closed"),
        (F.coalesce("umaResolutionStatus", F.lit("")) != "resolved", "uma_not_resolved"),
        (event.isNull(), "no_explicit_resolution_date"),
        (event > observed_at, "claimed_event_after_metadata_observation"),
        (F.coalesce(unparsed, F.lit(True)), "invalid_prices_or_outcomes"),
        (~F.coalesce(unparsed, F.lit(True)) & ~F.coalesce(structure, F.lit(False)), "ambiguous_binary_structure_or_prices"),
        (F.coalesce(structure, F.lit(False)) & payout.isNull(), "no_unambiguous_terminal_price_proxy"),
    ]
    issues = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in tests]))
    rows = raw.select(F.col("conditionId").alias("market_id"), payout.alias("p"), event.alias("event_at"), issues.alias("issues"))
    usable = F.size("issues") == 0
    return rows.select("market_id", F.when(usable, F.col("p")).alias("payout_yes"), "event_at", F.when(usable, F.col("event_at") + 1).alias("label_available_at"), F.when(usable, "metadata_proxy").otherwise("unusable").alias("tier"), "issues")


def chain_evidence(receipts: DataFrame) -> DataFrame:
    """(market_id, payout_yes, event_at, label_available_at, tier, reason) of verified receipts.

    receipts: market_id, numerators (two), first_slot, event_at, finality_at, observed_at (null:
    reconstructed), transaction_hash, verified. Invalid rows have a reason and no payout.
    """
    n, slot = F.col("numerators"), F.col("first_slot")
    total = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
    reason = (
        F.when(~F.coalesce("verified", F.lit(False)), "unverified")
        .when(~F.coalesce(F.rlike("transaction_hash", F.lit("^0x[0-9a-f]{64}$")), F.lit(False)), "bad_hash")
        .when(F.coalesce((F.size(n) != 2) | F.exists(n, lambda x: x < 0) | (total <= 0) | ~slot.isin(0, 1), F.lit(True)), "bad_payout")
        .when(F.coalesce(F.col("finality_at") < F.col("event_at"), F.lit(True)), "finality_before_event")
        .when(F.col("observed_at") < F.col("event_at"), "observed_before_event")
    )
    rows = receipts.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return rows.select(
        "market_id",
        F.when(ok, F.get(n, slot) / total).alias("payout_yes"),
        "event_at",
        F.when(ok, F.greatest("finality_at", "observed_at") + 1).alias("label_available_at"),
        F.when(~ok, "unusable").when(F.col("observed_at").isNull(), "chain_event_reconstructed").otherwise("chain_event_observed").alias("tier"),
        "reason",
    )


def label_boundary(evidence: DataFrame, as_of: int, allow_proxy: bool = False, require_observed: bool = False) -> DataFrame:
    """Labels known at as_of and of an allowed tier; history ends before event_at."""
    ok = (F.col("tier") != "unusable") & (F.col("label_available_at") <= as_of)
    if not allow_proxy:
        ok &= F.col("tier") != "metadata_proxy"
    if require_observed:
        ok &= F.col("tier") == "chain_event_observed"
    return evidence.where(ok).select("market_id", "payout_yes", "event_at", "label_available_at", "tier")


def _with_previous(tape: DataFrame) -> DataFrame:
    """tape with `before`, the ts of the market's print before.

    Prints are compared inside runs of seq; the last of a run is handed to the next that has any, so no window holds a market's prints.
    """
    rows = tape.withColumn("run", F.shiftright(F.col("seq").cast("long"), RUN_LOG2))
    last = rows.groupBy("market_id", "run").agg(F.max_by("ts", "seq").alias("last"))
    handed = last.select("market_id", "run", F.lag("last").over(Window.partitionBy("market_id").orderBy("run")).alias("handed"))
    inside = F.lag("ts").over(Window.partitionBy("market_id", "run").orderBy("seq"))
    return rows.withColumn("inside", inside).join(handed, ["market_id", "run"]).withColumn("before", F.coalesce("inside", "handed")).drop("run", "inside", "handed")


def tape_quality(tape: DataFrame, manifest: DataFrame) -> DataFrame:
    """(market_id, check, violations) of each violated check of a tape against its manifest (market_id, rows, start, end).

    Order of time; times inside the observation bounds [start, end]; prices there and in [0, 1]; sizes there, finite
    and above 0; sides 0 to 3; wallets there; the two prices' relation, to 1e-12; and the number of rows.
    """
    rows = _with_previous(tape).join(manifest.select("market_id", "start", "end"), "market_id", "left")
    mapped = F.when(F.col("side").isin(0, 2), F.col("yes_price")).otherwise(1 - F.col("yes_price"))

    def fails(good: Column) -> Column:
        return ~F.coalesce(good, F.lit(False))

    size = F.col("size")
    checks = {
        "order": F.col("ts") < F.col("before"),
        "bounds": (F.col("ts") < F.col("start")) | (F.col("ts") > F.col("end")),
        "price_range": fails(F.col("token_price").between(0, 1)) | fails(F.col("yes_price").between(0, 1)),
        "size": fails(~F.isnan(size) & (size > 0) & (size < float("inf"))),
        "side": fails(F.col("side").between(0, 3)),
        "wallet": F.col("wallet").isNull(),
        "price_mapping": F.abs(mapped - F.col("token_price")) > 1e-12,
    }
    counted = rows.groupBy("market_id").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in checks.items()])
    both = counted.join(manifest.select("market_id", "rows"), "market_id", "full_outer").withColumn("count", (~F.coalesce(F.col("n") == F.col("rows"), F.lit(False))).cast("long"))
    return both.fillna(0, list(checks)).unpivot("market_id", [*checks, "count"], "check", "violations").where("violations > 0")


def coverage_stats(tape: DataFrame, markets: DataFrame, settlements: DataFrame, sizes: list[int], start: int, end: int) -> DataFrame:
    """One row a cohort (the largest n markets, for each n): markets, with prints, prints, in the window, with prints there, settlements, distinct events, created before it.

    markets: market_id, rank, events (array of ids), created_at.
    """
    cohorts = F.explode(F.array_compact(F.array(*[F.when(F.col("rank") <= n, F.lit(n)) for n in sizes])))
    m = markets.select("market_id", "events", (F.col("created_at") < start).alias("early"), cohorts.alias("cohort"))
    per = tape.groupBy("market_id").agg(F.count("*").alias("prints"), F.count_if(F.col("ts").between(start, end)).alias("in_window"))
    settled = settlements.groupBy("market_id").agg(F.count("*").alias("settlements"))
    rows = m.join(per, "market_id", "left").join(settled, "market_id", "left").fillna(0, ["prints", "in_window", "settlements"])
    out = rows.groupBy("cohort").agg(F.count("*").alias("markets"), F.count_if(F.col("prints") > 0).alias("with_prints"), F.sum("prints").alias("prints"), F.sum("in_window").alias("in_window"), F.count_if(F.col("in_window") > 0).alias("with_window_prints"), F.sum("settlements").alias("settlements"), F.count_if("early").alias("created_before"))
    events = m.select("cohort", F.explode("events").alias("event")).groupBy("cohort").agg(F.countDistinct("event").alias("events"))
    return out.join(events, "cohort", "left").fillna(0, ["events"])


def market_payouts(markets: DataFrame, raw: DataFrame, tape: DataFrame) -> DataFrame:
    """(market_id, payout_yes, settled_at): legacy labels: YES 1, NO 0, closed and resolved at even prices 0.5; none without a date; never before the last print."""
    meta = raw.select(F.col("conditionId").alias("market_id"), F.when(F.col("closed") & (F.col("umaResolutionStatus") == "resolved") & (_payout() == 0.5), 0.5).alias("half"))
    last = tape.groupBy("market_id").agg(F.max("ts").alias("last"))
    rows = markets.join(meta, "market_id", "left").join(last, "market_id", "left")
    payout = F.coalesce(F.when(F.col("resolution") == "YES", 1.0).when(F.col("resolution") == "NO", 0.0), F.col("half"))
    at = F.unix_seconds("resolved_at")
    return rows.where(at.isNotNull() & payout.isNotNull()).select("market_id", payout.alias("payout_yes"), F.when(F.col("last") >= at, F.col("last") + 1).otherwise(at).alias("settled_at"))


def coalesce_metadata(new: DataFrame, old: DataFrame) -> DataFrame:
    """Newer markets win; a missing resolution (of closed markets only) and creation date come from the older copy; markets that only old has stay."""
    x, y = new.withColumn("in_new", F.lit(True)).alias("n"), old.alias("o")
    rows = x.join(y, F.col("n.market_id") == F.col("o.market_id"), "full_outer")
    is_new = F.col("in_new").isNotNull()
    out = []
    for c in new.columns:
        if c == "market_id":
            value = F.coalesce("n.market_id", "o.market_id")
        elif c == "created_at":
            value = F.coalesce(f"n.{c}", f"o.{c}")
        elif c in ("resolution", "resolved_at"):
            value = F.when(is_new, F.coalesce(F.col(f"n.{c}"), F.when(~F.col("n.active"), F.col(f"o.{c}")))).otherwise(F.col(f"o.{c}"))
        else:
            value = F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        out.append(value.alias(c))
    return rows.select(*out)


def timeline(tape: DataFrame, labels: DataFrame, tie: str = "resolution_first", start: int | None = None, end: int | None = None) -> DataFrame:
    """(ts, kind, market_id, seq, position): trades and resolutions as one ordered table; position, from 1, is by time, then kind by tie, market and seq.

    Positions are counted inside a minute, after the minutes of its day before, after the days before, so no task orders more than a minute's events.
    """
    if tie not in ("resolution_first", "trade_first"):
        raise ValueError(f"tie {tie!r} is not resolution_first or trade_first")
    first = tie == "resolution_first"
    trades = tape.select("ts", F.lit("trade").alias("kind"), "market_id", "seq", F.lit(1 if first else 0).alias("k"))
    ends = labels.where("payout_yes is not null").select(F.col("label_available_at").alias("ts"), F.lit("resolution").alias("kind"), "market_id", F.lit(0).cast("long").alias("seq"), F.lit(0 if first else 1).alias("k"))
    rows = trades.unionByName(ends)
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    if end is not None:
        rows = rows.where(F.col("ts") <= end)
    rows = rows.withColumns({"minute": F.floor(F.col("ts") / 60), "day": F.floor(F.col("ts") / 86400)})

    def before(order: str, by: list[str]) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    minutes = rows.groupBy("day", "minute").agg(F.count("*").alias("n"))
    days = minutes.groupBy("day").agg(F.sum("n").alias("n")).select("day", before("day", []).alias("of_days"))
    starts = minutes.select("day", "minute", before("minute", ["day"]).alias("of_minutes")).join(days, "day").select("minute", (F.col("of_days") + F.col("of_minutes")).alias("earlier"))
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy("minute").orderBy("ts", "k", "market_id", "seq"))).join(starts, "minute")
    return placed.select("ts", "kind", "market_id", "seq", (F.col("earlier") + F.col("nth")).alias("position"))
