"""Question vectors and market similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import similarity_kernel

#: Most centres that clusters of vectors form around.
CENTRES = 1024


def hashing_vectors(markets: DataFrame, features: int = 4096) -> DataFrame:
    """(market_id, vector): L2-normalised counts of the question's lower-case words of two or more letters, in hashed places."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    rows = RegexTokenizer(inputCol="q", outputCol="t", pattern=r"\b\w\w+\b", gaps=False).transform(markets.select("market_id", F.coalesce("question", F.lit("")).alias("q")))
    rows = Normalizer(inputCol="f", outputCol="v", p=2.0).transform(HashingTF(inputCol="t", outputCol="f", numFeatures=features).transform(rows))
    return rows.select("market_id", vector_to_array("v", "float32").alias("vector"))


def ngram_encoder(features: int = 64, n: int = 3) -> Callable[[list[str]], np.ndarray]:
    """An encoder for `encoded_vectors`: each run of n characters of the lower-cased text counts 1 or -1 in one of the places, both from its MD5."""

    def encode(texts: list[str]) -> np.ndarray:
        out, known = np.zeros((len(texts), features), np.float32), {}
        for row, text in zip(out, texts, strict=True):
            text = text.lower()
            for i in range(len(text) - n + 1):
                gram = text[i : i + n]
                if gram not in known:
                    digest = hashlib.md5(gram.encode()).hexdigest()
                    known[gram] = (int(digest[:8], 16) % features, 1 if int(digest[8], 16) % 2 else -1)
                place, sign = known[gram]
                row[place] += sign
        return out

    return encode


def encoded_vectors(markets: DataFrame, encoder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(market_id, vector) by a caller's batch encoder, run on Arrow batches; L2-normalised."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            v = np.asarray(encoder(pdf["question"].fillna("").tolist()), np.float32)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"market_id": pdf["market_id"], "vector": list(v)})

    kind = markets.schema["market_id"].dataType.simpleString()
    return markets.select("market_id", "question").mapInPandas(batches, f"market_id {kind}, vector array<float>")


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _dealt(vectors: DataFrame, threshold: float, block: int) -> DataFrame:
    """(market_id, vector, b, i, j): each vector in its block b, for each pair of blocks i <= j in which it may have a partner.

    Vectors go to the nearest of at most `CENTRES` of them; a cluster is cut into blocks by a hash.
    An angle to a partner is no less than that to the partner's centre less the cluster's radius, so
    a vector skips all clusters for which that is over the threshold's angle.
    """
    n = vectors.count()
    centres = vectors.orderBy(F.xxhash64("market_id"), "market_id").limit(min(CENTRES, max(1, -(-n // block)))).toPandas()
    kind = vectors.schema["market_id"].dataType.simpleString()
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], f"market_id {kind}, vector array<float>, b int, i int, j int")
    c = _unit(centres["vector"])

    def nearest(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            angles = _angles(_unit(pdf["vector"]) @ c.T)
            at = angles.argmin(1)
            yield pd.DataFrame({"c": at, "angle": angles[np.arange(len(at)), at]})

    stats = vectors.select("vector").mapInPandas(nearest, "c int, angle double").groupBy("c").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).toPandas()
    radius, blocks = np.full(len(c), -np.inf), np.zeros(len(c), np.int64)
    radius[stats["c"]], blocks[stats["c"]] = stats["radius"], -(-stats["n"] // block)
    first = np.concatenate(([0], np.cumsum(blocks)))
    reach = radius + float(_angles(np.array(threshold))) + 1e-6

    def placed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            angles = _angles(_unit(pdf["vector"]) @ c.T)
            at = angles.argmin(1)
            b = first[at] + pdf["sub"].to_numpy() % np.maximum(blocks[at], 1)
            near = angles <= reach
            near[np.arange(len(at)), at] = True
            with_ = [np.concatenate([np.arange(first[k], first[k + 1]) for k in np.flatnonzero(row)]) for row in near]
            yield pd.DataFrame({"market_id": pdf["market_id"], "vector": pdf["vector"], "b": b, "with": with_})

    rows = vectors.select("market_id", "vector", F.pmod(F.xxhash64("market_id"), F.lit(2**31 - 1)).alias("sub")).mapInPandas(placed, f"market_id {kind}, vector array<float>, b int, with array<int>")
    rows = rows.withColumn("k", F.explode("with"))
    return rows.select("market_id", "vector", "b", F.least("b", "k").alias("i"), F.greatest("b", "k").alias("j"))


def pair_work(vectors: DataFrame, threshold: float = 0.0, block: int = 512) -> DataFrame:
    """(i, j, n_left, n_right) for each pair of blocks that `market_pairs` multiplies, with the vectors that meet in it."""
    counts = _dealt(vectors, threshold, block).groupBy("i", "j").agg(F.count_if(F.col("b") == F.col("i")).alias("n_left"), F.count_if(F.col("b") == F.col("j")).alias("n_right"))
    return counts.where("n_left > 0 and n_right > 0")


def market_pairs(vectors: DataFrame, threshold: float = 0.0, power: float = 1.0, normalize: bool = True, block: int = 512) -> DataFrame:
    """(target, other, cosine, weight) of different markets with weight above 0.

    A task multiplies two blocks of near vectors as matrices, each pair of blocks once, and emits
    what has weight, in both directions, so that no row is made for a pair without. Vectors and
    blocks that no angle within the threshold can join never meet (`pair_work` counts the rest).
    """
    kind = vectors.schema["market_id"].dataType.simpleString()

    def product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        v, ids, b = _unit(pdf["vector"]), pdf["market_id"].to_numpy(), pdf["b"].to_numpy()
        left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
        cos = v[left] @ v[right].T
        above = cos > threshold
        x, y = np.nonzero(np.triu(above, 1) if i == j else above)
        t, o, c = ids[left[x]], ids[right[y]], cos[x, y]
        different = t != o
        t, o, c = t[different], o[different], c[different]
        return pd.DataFrame({"target": np.concatenate([t, o]), "other": np.concatenate([o, t]), "cosine": np.concatenate([c, c])})

    pairs = _dealt(vectors, threshold, block).groupBy("i", "j").applyInPandas(product, f"target {kind}, other {kind}, cosine double")
    return pairs.withColumn("weight", similarity_kernel(F.col("cosine"), threshold, power, normalize)).where("weight > 0")


def shuffle_vectors(vectors: DataFrame, seed: int, part: int = 4096) -> DataFrame:
    """(market_id, vector): the vectors dealt anew by a random order that depends on seed alone.

    Places are counted within ranges of the two orders, not by one global window. A range is given by bounds that
    the driver has read, one in `part` vectors but no more than `CENTRES`, so that a row's range is a
    fact of the row: whatever reads it again, in partitions of any kind, counts the same.
    """
    n = vectors.count()
    bounds = min(CENTRES, n // part)

    def placed(df: DataFrame, key: str) -> DataFrame:
        found = [r[0] for r in df.select(key).orderBy(F.xxhash64(key), key).limit(bounds).collect()]
        below = F.lit(0)
        if found:
            below = F.size(F.filter(F.array(*map(F.lit, found)), lambda x: x <= F.col(key)))
        ranged = df.withColumn("p", below)
        before = F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = ranged.groupBy("p").count().select("p", before.alias("start"))
        return ranged.join(F.broadcast(starts), "p").withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("p").orderBy(key, *[c for c in df.columns if c not in (key, "vector")])))

    ids = placed(vectors.select("market_id"), "market_id").select("place", "market_id")
    order = placed(vectors.select("vector", F.md5(F.concat(F.col("market_id").cast("string"), F.lit(f":{seed}"))).alias("k"), F.col("market_id").alias("id")), "k").select("place", "vector")
    return ids.join(order, "place").select("market_id", "vector")
