"""Line dedup (operator 4), in DataFrame operations only: distinct-site spread.

Every normalised line (A-Z lower-cased, white space as single spaces) is hashed; a HyperLogLog
sketch per line hash counts the distinct sites (`source`) that have it. Sketches are built per
task and merge in the aggregation; `spread` may also be stored and merged with later ones. A
line whose estimate is within `margin` of `min_sites` gets an exact distinct count. Lines on
`min_sites` sites or more are boilerplate and leave every document. A text that stands on several
sites, letter for letter, is one text of its first site: that it was copied does not make its
lines boilerplate.

Lines without a word stay. A null or empty text stays as it is; a null site is one more site;
repeated rows give equal results and count once. An empty table gives no rows. Columns of any
name are carried along. The work for a text is that of sorting its lines. The sketch has 2^12
registers (standard error 1.6 %), so with a margin of a quarter an estimate on the wrong side
would be off by 15 standard errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import boxed, inside, scratch, table
from tapeworks.llm.native import has_word, line_table, text_of, without_lines

MIN_SITES = 10
MARGIN = 0.25
REGISTERS_LOG2 = 12


def line_rows(docs: DataFrame, text_column: str = "text", site_column: str = "source") -> DataFrame:
    """(hash, length, site, lines): each distinct text, once, with the first of its sites."""
    text = text_of(F.col(text_column))
    site = F.coalesce(F.col(site_column).cast("string"), F.lit("\0null"))
    rows = docs.select(F.xxhash64(text).alias("hash"), F.length(text).alias("length"), site.alias("site"), line_table(text).alias("lines"))
    return rows.groupBy("hash", "length").agg(F.min("site").alias("site"), F.first("lines").alias("lines"))


def spread(rows: DataFrame) -> DataFrame:
    """(h, sites): a HyperLogLog sketch of the sites of each line hash."""
    return rows.select("site", F.explode("lines.h").alias("h")).groupBy("h").agg(F.hll_sketch_agg("site", F.lit(REGISTERS_LOG2)).alias("sites"))


def merge(spreads: DataFrame) -> DataFrame:
    """Sketches of several runs as one for each line hash."""
    return spreads.groupBy("h").agg(F.hll_union_agg("sites").alias("sites"))


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(h): hashes of lines on min_sites sites or more; exact."""
    estimate = spread(rows).select("h", F.hll_sketch_estimate("sites").alias("n")).where(F.col("n") >= (1 - margin) * min_sites)
    estimate = scratch(estimate, "spread")
    near = estimate.where(F.col("n") <= (1 + margin) * min_sites).select("h")
    exact = rows.select("site", F.explode("lines.h").alias("h")).join(near, "h", "left_semi").distinct().groupBy("h").count().where(F.col("count") >= min_sites)
    return estimate.where(F.col("n") > (1 + margin) * min_sites).select("h").unionByName(exact.select("h"))


def marked(docs: DataFrame, text_column: str = "text", site_column: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(row, cut, n_lines, n_removed): each row of docs as one column, its text without boilerplate lines, its lines with a word, and how many of them left."""
    rows = scratch(line_rows(docs, text_column, site_column), "lines")
    key = ["hash", "length"]
    held = rows.select(*key, F.explode("lines").alias("l")).select(*key, F.col("l.h").alias("h"), F.col("l.at").alias("at"))
    found = held.join(boilerplate(rows, min_sites), "h").groupBy(*key).agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("gone"))
    found = scratch(found, "found")  # a table, so that a hot text's join can be split
    text = text_of(inside(text_column))
    # found grows with the documents, so it is never broadcast, however small it is here
    out = boxed(docs).withColumns({"hash": F.xxhash64(text), "length": F.length(text)}).join(found.hint("merge"), key, "left")
    return out.select(
        "row",
        F.when(F.col("gone").isNotNull(), without_lines(text, F.col("gone"))).otherwise(inside(text_column)).alias("cut"),
        F.size(F.filter(F.split(text, "\n"), has_word)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup(docs: DataFrame, text_column: str = "text", site_column: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs, with all their columns, without boilerplate lines."""
    out = marked(docs, text_column, site_column, min_sites)
    return out.select(*[(F.col("cut") if c == text_column else inside(c)).alias(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = marked(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(inside("doc_id").alias("doc_id"), "n_lines", "n_removed", F.col("cut").alias("text"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(text, '') AS t, coalesce(source, chr(1)) AS site FROM documents),
p AS (SELECT t, site, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM (SELECT t, min(site) AS site FROM d GROUP BY t)),
l AS (SELECT t, site, line, i, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS nl FROM p),
bad AS (SELECT nl FROM l WHERE nl <> '' GROUP BY nl HAVING count(DISTINCT site) >= 10),
m AS (SELECT l.*, bad.nl IS NOT NULL AS b FROM l LEFT JOIN bad ON l.nl = bad.nl),
t AS (SELECT t, count(*) FILTER (nl <> '') AS n_lines, count(*) FILTER (b) AS nb, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT b), '') AS cut FROM m GROUP BY t)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(nb AS BIGINT) AS n_removed, CASE WHEN nb > 0 THEN cut ELSE text END AS text
FROM d JOIN t ON d.t = t.t
"""
