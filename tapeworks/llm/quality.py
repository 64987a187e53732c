"""Quality rules (operator 5), in DataFrame operations only: cross-document line frequency.

Base rules count words, symbols, repeated lines and words of repeated 8-word windows inside
each text, in its row. The method's rule hashes every normalised line, counts the distinct
documents of a host (`source`) in which it stands, and holds lines in more than `min_docs` of them
to be boilerplate, if they are also in more than `line_percent` per cent of the host's distinct
documents or in more than `max_docs`. (Texts of one host seldom share a line by chance, so one in a
hundred is many; and on a host of any size a line of a thousand documents is not one document's
own.) A document
that loses more than half of its words with them, or keeps fewer than `min_words`, is depleted
and rejected. Copies of one text count as one document of their host, so that a group of exact
copies does not make its own lines boilerplate.

A null or empty text has no words and fails the base rules. A null host is a host of its own.
Repeated rows get equal results; an empty table gives no rows; columns of any name are carried
along. Windows and lines are compared by 64-bit hashes.
Distinct texts of a host are told apart by xxhash64 and length. Counting aggregates before it
shuffles, so a very common line or a hot host arrives as one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import boxed, inside, scratch, table
from tapeworks.llm.native import SPACES, let, line_table, lines, text_of, without_lines, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
LINE_PERCENT = 1
MIN_DOCS = 10
MAX_DOCS = 1000
SYMBOLS = "#*$%&|<>"


def repeat_words(word_array: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows that are found twice or more in the array.

    The window hashes are compared as a set first; only texts with a repetition sort them.
    """

    def covered(hashed: Column) -> Column:
        ordered = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda e, i: F.get(s, i - 1)["h"].eqNullSafe(e["h"]) | F.get(s, i + 1)["h"].eqNullSafe(e["h"])), lambda e: e["i"])))
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def counted(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))

    return let(F.transform(word_array, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) > window, counted(h)).otherwise(0)).cast("long")


def base(text: Column) -> dict[str, Column]:
    """The base counts of a text that is not null."""
    both = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    return {
        "__words": both,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def measured(rows: DataFrame, text: Column) -> DataFrame:
    """rows with the base counts and base_failed of a text; one pass, no shuffle."""
    out = rows.withColumns(base(text_of(text))).withColumns({"n_words": F.col("__words.n"), "n_repeat_words": F.col("__words.r")}).drop("__words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def text_key(text: Column, host: Column) -> dict[str, Column]:
    return {"host": F.coalesce(host.cast("string"), F.lit("\0null")), "hash": F.xxhash64(text_of(text)), "length": F.length(text_of(text))}


KEY = ["host", "hash", "length"]


def boilerplate(docs: DataFrame, text_column: str = "text", host_column: str = "source", min_docs: int = MIN_DOCS, line_percent: float = LINE_PERCENT, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, hash, length, gone, removed): each distinct text of a host that has boilerplate lines, the numbers of those lines and the words they hold in it."""
    text, host = F.col(text_column), F.col(host_column)
    texts = docs.select(*[c.alias(k) for k, c in text_key(text, host).items()], line_table(text_of(text)).alias("lines")).dropDuplicates(KEY)
    texts = scratch(texts, "lines")
    hosts = scratch(texts.groupBy("host").agg(F.count("*").alias("host_docs")), "hosts")
    counts = texts.select("host", F.explode("lines.h").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    counts = scratch(counts, "counts")  # both sides are tables, so that the join on a hot host can be split
    many = (F.col("n_docs") > max_docs) | (100 * F.col("n_docs") > line_percent * F.col("host_docs"))
    bad = counts.join(hosts, "host").where(many).select("host", "h")
    held = texts.select(*KEY, F.explode("lines").alias("line")).select(*KEY, F.col("line.h").alias("h"), F.col("line.at").alias("at"), (F.col("line.w") * F.size("line.at")).alias("w"))
    found = held.join(bad, ["host", "h"]).groupBy(*KEY).agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("gone"), F.sum("w").alias("removed"))
    return scratch(found, "found")  # a table, so that a hot text's join can be split


def judged(docs: DataFrame, text_column: str = "text", host_column: str = "source", carry: list[str] | None = None, **limits: float) -> DataFrame:
    """Each row of docs as one column, `row` (of the columns `carry`; of all, if None), with the base counts, base_failed, kept, and gone (the numbers of its boilerplate lines, or null)."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    text, host = inside(text_column), inside(host_column)
    rows = measured(boxed(docs), text).withColumns(text_key(text, host))
    row = F.col("row") if carry is None else F.struct(*[inside(c).alias(c) for c in carry]).alias("row")
    rows = rows.select(row, *counts, *KEY)
    # what boilerplate finds grows with the documents, so it is never broadcast, however small it is here
    out = rows.join(boilerplate(docs, text_column, host_column, **limits).hint("merge"), KEY, "left")
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    depleted = F.col("removed").isNotNull() & ((left < MIN_WORDS) | (2 * left < F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("removed", *KEY)


def clean(docs: DataFrame, text_column: str = "text", host_column: str = "source", **limits: float) -> DataFrame:
    """The documents that are kept, with the columns of docs, without their boilerplate lines; text that has none stays as it is."""
    out = judged(docs, text_column, host_column, **limits).where("kept")
    text = inside(text_column)
    cut = F.when(F.col("gone").isNotNull(), without_lines(text_of(text), F.col("gone"))).otherwise(text)
    return out.select(*[(cut if c == text_column else inside(c)).alias(c) for c in docs.columns])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judged(docs, carry=["doc_id"]).select(inside("doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS host FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS s FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
repw AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(8) AS o(k) GROUP BY r),
l AS (SELECT r, host, t, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS nl
      FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
hosts AS (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY host),
bad AS (SELECT c.host, c.nl FROM (SELECT host, nl, count(DISTINCT t) AS n FROM l GROUP BY host, nl) c JOIN hosts h ON c.host = h.host WHERE c.n > 10 AND (c.n > 1000 OR 100 * c.n > h.n)),
gone AS (SELECT l.r, sum(len(string_split(l.nl, ' '))) AS n FROM l JOIN bad ON l.host = bad.host AND l.nl = bad.nl GROUP BY l.r),
m AS (SELECT d.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repw.n, 0) AS BIGINT) AS n_repeat_words, gone.n AS gone
      FROM d JOIN w ON d.r = w.r LEFT JOIN dup ON d.r = dup.r LEFT JOIN repw ON d.r = repw.r LEFT JOIN gone ON d.r = gone.r),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (gone IS NULL OR NOT (n_words - gone < 20 OR 2 * (n_words - gone) < n_words)) AS kept
FROM j
"""
