"""Language identification (operator 8): multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (1 to 3 code points of the lower-cased text) by language and bucket in
every task, dense in memory for at most `HELD` languages at a time, and sums the counts by a grouped
aggregation. The prior of a language is its share of the training documents. The log probabilities
of at most `LANG_BLOCK` languages at a time (`BUCKETS` numbers each, whatever the number of
documents) go to the driver and are broadcast; more languages mean more passes over the documents,
each of which carries the best language and the sum of likelihoods on, so any number of languages
gives the same result in bounded memory.

The prediction reads the text alone. Its score is the posterior of the predicted language,
from 0 to 1. A null text, or one without a letter, is `und` with score 0; so is every text if
there is nothing to learn from. Of equal posteriors the alphabetically first language wins.
Very long texts are read whole, in parts of `CHARS` code points, each of which also sees the start
of the next, so that no n-gram is lost or read twice. Repeated rows and ids give a result each; an
empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import discard, fold, from_key, id_key, runs_of_chars, scratch, table

BUCKETS = 1 << 15
ORDERS = 3
LANG_BLOCK = 64
HELD = 64
CHARS = 1 << 18
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each code point of the joined texts, BUCKETS where it would cross the end of its text; and the texts' starts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    last = np.zeros(len(codes) + ORDERS, bool)
    last[(starts + lengths - 1)[lengths > 0]] = True
    out, h, crossing = [], np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool)
    padded = np.concatenate((codes, np.zeros(ORDERS, np.uint32)))
    for k in range(ORDERS):
        h = (h ^ padded[k : k + len(codes)]) * _MIX[k]
        h ^= h >> np.uint32(15)
        if k:
            crossing = crossing | last[k - 1 : k - 1 + len(codes)]
        out.append(np.where(crossing, np.uint32(BUCKETS), (h * _MIX[2]) >> np.uint32(17)))
    return out, starts


def _parts(texts: list[str]) -> Iterator[tuple[list[int], list[str], int | None]]:
    """Rows and texts to count, in bounded parts, and how many n-gram starts of the joined texts count (None: all); a long text comes in several."""
    for a, b in runs_of_chars([len(t) for t in texts], CHARS):
        if b - a == 1 and len(texts[a]) > CHARS:
            t = texts[a]
            for i in range(0, len(t), CHARS):
                yield [a], [t[i : i + CHARS + ORDERS - 1]], CHARS
        else:
            yield list(range(a, b)), texts[a:b], None


def count_grams(train: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows that have both a text and a language; bucket `BUCKETS` has the number of such rows."""

    def counted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, c in counts.items():
                used = np.flatnonzero(c)
                yield pd.DataFrame({"lang": lang, "bucket": used.astype(np.int32), "n": c[used]})
            counts.clear()

        for pdf in it:
            for lang, group in pdf.groupby("lang", sort=False):
                if lang not in counts and len(counts) == HELD:
                    yield from flush()
                into = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for _, texts, stop in _parts([t.lower() for t in group["text"]]):
                    for g in grams(texts)[0]:
                        into[:BUCKETS] += np.bincount(g[:stop], minlength=BUCKETS + 1)[:BUCKETS]
                into[BUCKETS] += len(group)
        yield from flush()

    rows = train.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang")).where("text is not null and lang is not null")
    return rows.mapInPandas(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


#: Languages in order, their log priors, and a float32 matrix of log probabilities with a last column of zeros.
Block = tuple[list[str], np.ndarray, np.ndarray]


def model_blocks(counts: DataFrame, alpha: float = 0.1) -> list[Callable[[], Block]]:
    """The model in blocks of at most LANG_BLOCK languages, each read from counts when it is called for."""
    langs = [(r["lang"], r["n"]) for r in counts.where(F.col("bucket") == BUCKETS).select("lang", "n").orderBy("lang").collect()]
    rows = sum(n for _, n in langs)

    def block(some: list[tuple[str, int]]) -> Block:
        names = [x for x, _ in some]
        got = counts.where(F.col("lang").isin(names) & (F.col("bucket") < BUCKETS)).toArrow().to_pandas()  # at most BUCKETS x LANG_BLOCK rows
        m = np.full((len(names), BUCKETS), alpha)
        m[got["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(np.int64), got["bucket"]] += got["n"]
        m = np.log(m / m.sum(axis=1, keepdims=True))
        return names, np.log([n / rows for _, n in some]), np.hstack([m, np.zeros((len(names), 1))]).astype(np.float32)

    return [partial(block, langs[i : i + LANG_BLOCK]) for i in range(0, len(langs), LANG_BLOCK)]


def log_likelihoods(texts: list[str], block: Block) -> np.ndarray:
    """Language by text: log prior plus log probability of the lower-cased text's n-grams."""
    names, prior, logp = block
    total = np.repeat(prior[:, None], len(texts), axis=1)
    for rows, parts, stop in _parts(texts):
        keep = [i for i, t in enumerate(parts) if t]
        if keep:
            per_order, starts = grams([parts[i] for i in keep])
            for k in range(len(names)):
                sums = sum(logp[k][g[:stop]] for g in per_order)
                total[k, [rows[i] for i in keep]] += np.add.reduceat(sums, starts, dtype=np.float64)
    return total


def predict(docs: DataFrame, model: list[Callable[[], Block]], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(id_key(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("rest"))

    def scored(shared) -> Callable:
        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                texts = [t.lower() if t else "" for t in pdf["text"]]
                total = log_likelihoods(texts, shared.value)
                before, top = pdf["top"].to_numpy(np.float64), total.max(axis=0)
                best = np.maximum(before, top)
                rest = np.exp(total - best).sum(axis=0) + pdf["rest"].to_numpy(np.float64) * np.exp(np.where(np.isfinite(before), before - best, 0))
                lang = np.where(top > before, np.array(shared.value[0], object)[total.argmax(axis=0)], pdf["lang"].to_numpy(object))
                lang[[not any(map(str.isalpha, t)) for t in texts]] = None
                yield pd.DataFrame({"id": pdf["id"], "text": pdf["text"], "lang": lang, "top": best, "rest": rest})

        return batches

    columns, held, shared = "id long, text string, lang string, top double, rest double", None, None
    for block in model:
        if shared is not None:  # one block of languages is broadcast at a time
            done = scratch(rows, "scored")
            shared.destroy()
            if held is not None:
                discard(held)
            rows = held = done
        shared = spark.sparkContext.broadcast(block())
        rows = rows.mapInPandas(scored(shared), columns)
    score = F.when(F.col("lang").isNotNull(), 1 / F.col("rest")).otherwise(0.0)
    return rows.select(from_key("id").alias("id"), F.coalesce("lang", F.lit("und")).alias("lang_pred"), score.alias("score"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = scratch(count_grams(docs.where(fold("doc_id", 4) != 2)), "grams")
    return predict(docs, model_blocks(counts)).select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "lang_pred", "score")
