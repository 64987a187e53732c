"""Mixing sources to target weights (operator 13): Sainte-Laguë apportionment of equal blocks.

A document's size is its words (runs of anything but the six ASCII white-space characters). All
sizes together are shared among the sources by weight, no source above `CAP` times its own size;
what is above is shared again by weight. The targets are then met in blocks of equal words: the
house of all blocks goes to the sources by highest quotients target / (2k - 1), and a source's
blocks go to its shards in the same way, by their sizes. A shard takes whole passes over its
documents, and of its blocks the rest, evenly spaced from a seeded start, where the documents
stand in the order of a seeded hash. No block is taken more than CAP times, so no document is.

Only (id, source, size) moves. A shard is a seeded deal of a source's documents, so a source of a third
of all rows is many shards; one task orders a shard's documents, and one orders the sources (a row
each). A source has at most `SHARDS` shards until their blocks number 2^30.

A null or empty text has size 0 and is taken 0 times; a null source is the last source; repeated
rows are documents like others; a null id is hashed as empty. An empty table, or one without
words, gives targets of 0. Equal quotients go to the smaller number of source or shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tapeworks.llm.common import discard, scratch, table

WEIGHTS, CAP, SEED = (1, 2, 3), 3, 13
#: Words of a block: a thousandth of the smallest source, within these bounds; blocks of a shard, and shards of a source.
BLOCK, PER_SHARD, SHARDS = 1024, 1024, 4096


def sizes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, source, size)."""
    n = F.regexp_count(F.col(text_column).cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.coalesce(n, F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources (number, weight, source_size) with target: all sizes shared by weight, none above cap times its own.

    Each round takes those above their limit out and shares the rest again. A round sums two columns; it only adds to those taken out.
    """
    limit = F.col("source_size") * cap
    total, weight, gone = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)), F.lit(0)).first()
    left, out = total, -1
    while True:
        share = left / weight if weight else float("inf")
        above = limit < F.lit(share) * F.col("weight")
        if gone == out or not weight:
            return sources.withColumn("target", F.when(above, limit.cast("double")).otherwise(F.lit(share if weight else 0.0) * F.col("weight")))
        out = gone
        gone, used, weight = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        left = total - used


def sainte_lague(parties: DataFrame, house: DataFrame) -> DataFrame:
    """(g, party, seats): each group's seats to its parties by highest quotients votes / (2k - 1), k at most `most`.

    parties: g, party, votes, most; house: g, seats. The divisor is known within half a seat a
    party, so all quotients above that range have seats, those below have none, and only those
    inside, about two for each party, are ordered. Equal quotients: the smaller party. If limits
    leave seats over after those, they stay empty.
    """
    n, votes = F.col("n"), F.col("all_votes")
    sums = parties.groupBy("g").agg(F.count("*").alias("n"), F.sum("votes").alias("all_votes")).where("all_votes > 0").join(house, "g")
    rows = parties.join(sums.select("g", "seats", ((F.col("seats") - n / 2 - 1) / votes).alias("least"), ((F.col("seats") + 2 * n + 2) / votes).alias("largest")), "g")

    def at(scale: str) -> Column:
        return F.least(F.greatest(F.floor(F.col("votes") * F.col(scale) + 0.5), F.lit(0)), F.col("most")).cast("long")

    rows = scratch(rows.select("g", "party", "votes", "seats", at("least").alias("sure"), at("largest").alias("possible")), "parties")
    asked = rows.where("possible > sure").select("g", "party", "votes", F.explode(F.sequence(F.col("sure") + 1, F.col("possible"))).alias("k"))
    order = Window.partitionBy("g").orderBy(F.desc(F.col("votes") / (2 * F.col("k") - 1)), "party")
    rest = rows.groupBy("g").agg((F.first("seats") - F.sum("sure")).alias("rest"))
    more = asked.withColumn("nth", F.row_number().over(order)).join(rest, "g").where("nth <= rest").groupBy("g", "party").agg(F.count("*").alias("more"))
    return rows.join(more, ["g", "party"], "left").select("g", "party", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("seats"))


def _number(text: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(text, first, digits), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target (its source's), taken (words that the mix takes, repeats counted) of every document.

    weights go to the sources in code-point order (null last), repeating.
    """
    rows = scratch(sizes(docs, id_column, text_column, source_column), "sizes")
    number = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).cast("long")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("number", number)
    sources = scratch(sources.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))), "sources")
    total, smallest = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.min(F.when(F.col("source_size") > 0, F.col("source_size")))).first()
    block = max(1, min(BLOCK, (smallest or 1) // 1024))
    shards = F.greatest(F.lit(1), F.least(F.lit(SHARDS), F.expr(f"source_size div {block * PER_SHARD}")), F.expr(f"source_size div {block << 30}"))
    weighed = sources
    sources = scratch(targets(sources, cap).withColumn("shards", shards), "targets")

    told = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    dealt = rows.withColumnRenamed("source", "of").join(sources, F.col("of").eqNullSafe(F.col("source"))).withColumn("told", told)
    dealt = scratch(dealt.select("doc_id", "source", "size", "source_size", "target", "number", (_number(F.col("told"), 16, 8) % F.col("shards")).alias("shard"), _number(F.col("told"), 1, 15).alias("r")), "dealt")
    parts = scratch(dealt.groupBy("number", "shard").agg(F.sum("size").alias("words")).withColumn("blocks", F.expr(f"(words + {block - 1}) div {block}")), "shards")

    most = parts.groupBy(F.col("number").alias("party")).agg(F.sum(F.col("blocks") * cap).alias("most"))
    first = sources.select(F.lit(0).alias("g"), F.col("number").alias("party"), F.col("target").alias("votes")).join(most, "party")
    first = scratch(first, "first")  # a table: a constant group would turn its joins into products
    house = sources.sparkSession.createDataFrame([(0, (total + block // 2) // block)], "g int, seats long")
    quotas = sainte_lague(first, house).select(F.col("party").alias("g"), "seats")
    of_shards = sainte_lague(parts.select(F.col("number").alias("g"), F.col("shard").alias("party"), F.col("words").cast("double").alias("votes"), (F.col("blocks") * cap).alias("most")), quotas)
    plan = parts.join(of_shards.select(F.col("g").alias("number"), F.col("party").alias("shard"), "seats"), ["number", "shard"], "left")
    start = _number(F.md5(F.concat_ws("|", F.lit(seed), "number", "shard").cast("binary")), 1, 15) % F.greatest("blocks", F.lit(1))
    plan = scratch(plan.select("number", "shard", "blocks", F.coalesce("seats", F.lit(0)).alias("seats"), start.alias("start")), "plan")
    discard(rows, weighed, sources, first, parts, of_shards)

    order = Window.partitionBy("number", "shard").orderBy("r", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum("size").over(order)).join(plan, ["number", "shard"])
    return placed.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, _taken(block)).otherwise(0).cast("long").alias("taken"))


def _taken(block: int) -> Column:
    """Words of a document at [end - size, end) of its shard that fall to taken blocks: whole passes, and of the rest of the seats each block at which the running share of blocks passes a whole number."""
    begin, end, blocks = F.col("end") - F.col("size"), F.col("end"), F.col("blocks")
    passes, rest = F.expr("seats div blocks"), F.col("seats") % blocks
    x, y = F.floor(begin / block), F.floor((end - 1) / block)

    def before(j: Column) -> Column:
        return F.floor(((j + F.col("start")) * rest).cast("decimal(38,0)") / blocks.cast("decimal(20,0)"))

    def chosen(j: Column) -> Column:
        return before(j + 1) - before(j)

    inner = F.greatest(before(y) - before(x + 1), F.lit(0)) * block
    ends = chosen(x) * (F.least(end, (x + 1) * block) - begin) + F.when(y > x, chosen(y) * (end - y * block)).otherwise(0)
    return passes * F.col("size") + inner + ends


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: All quotients are ordered here, and all limits tried in order.
OP13_SQL = r"""
WITH docs AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size, md5('13|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS told FROM documents),
sources AS (SELECT *, 1 + number % 3 AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS number FROM docs GROUP BY source)),
b AS (SELECT CAST(greatest(1, least(1024, coalesce(min(source_size) FILTER (source_size > 0), 1) // 1024)) AS BIGINT) AS b, CAST(sum(source_size) AS BIGINT) AS total FROM sources),
tried AS (SELECT out, (total - limits)::DOUBLE / rest AS share, next FROM (
  SELECT k AS out, coalesce(sum(3 * source_size) FILTER (r <= k), 0) AS limits, sum(weight) FILTER (r > k) AS rest, min(3 * source_size / weight) FILTER (r > k) AS next
  FROM (SELECT *, row_number() OVER (ORDER BY source_size / weight, number) AS r FROM sources), (SELECT unnest(range((SELECT count(*) FROM sources))) AS k) GROUP BY k), b WHERE rest > 0),
share AS (SELECT arg_min(share, out) AS share FROM tried WHERE next >= share),
targets AS (SELECT s.*, least(CAST(3 * source_size AS DOUBLE), share * weight) AS target, greatest(1, least(4096, source_size // (b * 1024))) AS shards FROM sources s, share, b),
dealt AS (SELECT doc_id, size, source_size, target, number, ('0x' || substr(told, 16, 8))::BIGINT % shards AS shard, ('0x' || substr(told, 1, 15))::BIGINT AS r FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
parts AS (SELECT number, shard, CAST(sum(size) AS BIGINT) AS words, CAST((sum(size) + b - 1) // b AS BIGINT) AS blocks FROM dealt, b GROUP BY number, shard, b),
quotas AS (SELECT number, count(*) FILTER (nth <= (total + b // 2) // b) AS seats FROM (SELECT number, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, number) AS nth FROM (
  SELECT t.number, target, unnest(range(1, m + 1)) AS k FROM targets t JOIN (SELECT number, CAST(sum(3 * blocks) AS BIGINT) AS m FROM parts GROUP BY number) p ON t.number = p.number WHERE target > 0)), b GROUP BY number),
shares AS (SELECT number, shard, count(*) FILTER (nth <= seats) AS seats FROM (SELECT p.number, shard, seats, row_number() OVER (PARTITION BY p.number ORDER BY words::DOUBLE / (2 * k - 1) DESC, shard) AS nth FROM (SELECT *, unnest(range(1, 3 * blocks + 1)) AS k FROM parts) p JOIN quotas q ON p.number = q.number) GROUP BY ALL),
plan AS (SELECT p.number, p.shard, blocks, coalesce(seats, 0) AS seats, ('0x' || substr(md5('13|' || p.number || '|' || p.shard), 1, 15))::BIGINT % greatest(blocks, 1) AS start FROM parts p LEFT JOIN shares s ON p.number = s.number AND p.shard = s.shard),
chosen AS (SELECT number, shard, j, seats // blocks + (j + 1 + start) * (seats % blocks) // blocks - (j + start) * (seats % blocks) // blocks AS times FROM (SELECT *, unnest(range(blocks)) AS j FROM plan)),
placed AS (SELECT *, sum(size) OVER (PARTITION BY number, shard ORDER BY r, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a FROM dealt),
hits AS (SELECT p.doc_id, sum(times * (least(a + size, (j + 1) * b) - greatest(a, j * b))) AS taken FROM placed p, b JOIN chosen c ON c.number = p.number AND c.shard = p.shard AND c.j >= p.a // b AND c.j <= (p.a + p.size - 1) // b WHERE p.size > 0 GROUP BY p.doc_id)
SELECT p.doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed p LEFT JOIN hits h ON p.doc_id = h.doc_id
"""
