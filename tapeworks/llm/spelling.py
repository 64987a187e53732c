"""Spelling variant grouping (operator 11): k-d trees over letter-count vectors.

Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z lower-cased. Two words
are near if they differ by one inserted, deleted or replaced code point. Then their letter counts
differ by one letter more, or by one letter more and one less: an L1 distance of at most two. A
word is therefore searched for among the words of its own length and of the next, each length in a
k-d tree over the counts: boxes out of reach are pruned, in what is left a product of matrices
finds the pairs of distance two or less, and the letters' order decides.

The upper part of a length's tree deals the words to groups of about `GROUP` words; it is built
from a sample of at most about `SAMPLE` words (whole counts decide nothing there, only where a word
is compared) and has at most SAMPLE / 8 leaves, whatever the corpus. A word visits the groups whose
boxes its range meets. Inside a group the tree goes on. No two words are compared outside of such
leaves, a word has at most about 180 near words for each of its letters, and each pair is found once.

A null or empty text has no words, an empty table gives no rows, repeated rows count as often as
they stand there. A run longer than a piece of a very long text stays whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import discard, scratch, table

#: Least code points and occurrences of a word, and how much more frequent its form is.
LEAST, TWICE, TIMES = 7, 2, 10
SAMPLE, GROUP, LEAF, LONG = 50_000, 20_000, 256, 256
PIECE, HELD, ROWS = 4 << 20, 200_000, 50_000

#: Letters are one byte each in Latin-1; other characters part words, as `?` does.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUN, _GAP = re.compile(rb"[a-z\xc0-\xff]+"), re.compile(rb"[^a-z\xc0-\xff]")
_LETTERS = [*range(97, 123), *range(0xC0, 0x100)]
_PLACE = np.zeros(256, np.int64)
_PLACE[_LETTERS] = np.arange(len(_LETTERS))
DIMS = len(_LETTERS)


def _pieces(folded: bytes) -> Iterator[bytes]:
    at = 0
    while len(folded) - at > PIECE:
        gap = _GAP.search(folded, at + PIECE)
        if gap is None:
            break
        yield folded[at : gap.start()]
        at = gap.start()
    yield folded[at:] if at else folded


def slip(run: bytes, crc: int) -> bytes:
    """The run, without one letter if 31 divides its hash."""
    if crc % 31:
        return run
    k = crc % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", slips: bool = True, least: int = LEAST) -> DataFrame:
    """(word, n): the words of at least `least` letters and their occurrences over all texts.

    With slips, a run of a document loses the letter that the crc32 of `<id>:<run>` names, if 31
    divides it (a null id is empty there). Counts are added up in a task before they are shuffled.
    """
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            rows = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for batch in it:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                seed = zlib.crc32((key.as_py() or "").encode() + b":")
                for piece in _pieces((text.as_py() or "").encode("latin-1", "replace").translate(_FOLD)):
                    for w, n in Counter(runs.findall(piece)).items():
                        if slips:
                            w = slip(w, zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), seed))
                            if len(w) < least:
                                continue
                        held[w] = held.get(w, 0) + n
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters(words: list[str] | pd.Series | np.ndarray) -> np.ndarray:
    """Words of one length as an array of their Latin-1 bytes, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def counts(rows: np.ndarray) -> np.ndarray:
    """How often each word has each letter, at most 255 (a smaller difference prunes less, never more)."""
    out = np.empty((len(rows), DIMS), np.uint8)
    step = max(1, (1 << 20) // (rows.shape[1] + DIMS))
    for a in range(0, len(rows), step):
        part = rows[a : a + step]
        at = np.arange(len(part))[:, None] * DIMS + _PLACE[part]
        out[a : a + step] = np.minimum(np.bincount(at.ravel(), minlength=len(part) * DIMS), 255).reshape(len(part), DIMS)
    return out


class Tree:
    """A k-d tree: inner nodes split one letter's count at a cut, `leaves` holds the places of the vectors in each leaf."""

    def __init__(self, vectors: np.ndarray, leaf_size: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # letter, cut, below or at it, above it; a child is a node, or ~leaf
        self.leaves: list[np.ndarray] = []
        waiting = [(np.arange(len(vectors)), -1, 0)]
        self.root = 0
        while waiting:
            at, parent, side = waiting.pop()
            split = self._split(vectors[at]) if len(at) > leaf_size else None
            if split is None:
                me = ~len(self.leaves)
                self.leaves.append(at)
            else:
                me = len(self.nodes)
                self.nodes.append((*split, 0, 0))
                low = vectors[at, split[0]] <= split[1]
                waiting += [(at[~low], me, 3), (at[low], me, 2)]
            if parent < 0:
                self.root = me
            else:
                node = list(self.nodes[parent])
                node[side] = me
                self.nodes[parent] = tuple(node)

    @staticmethod
    def _split(part: np.ndarray) -> tuple[int, int] | None:
        """The letter and cut that halve the vectors best; None if all are equal."""
        low = np.stack([(part <= cut).sum(0) for cut in range(4)])
        best = int(np.argmax(np.minimum(low, len(part) - low)))
        cut, letter = divmod(best, part.shape[1])
        if 0 < low[cut, letter] < len(part):
            return letter, cut
        least, most = part.min(0).astype(int), part.max(0).astype(int)
        letter = int(np.argmax(most - least))
        return (letter, int(least[letter] + most[letter]) // 2) if most[letter] > least[letter] else None

    def search(self, vectors: np.ndarray, less: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places of the vectors) for each leaf that has room for one letter more and, if `less`, one letter less."""
        none = np.zeros(len(vectors), bool)
        waiting = [(self.root, np.arange(len(vectors)), none, none)]
        while waiting:
            node, at, up, down = waiting.pop()
            if not len(at):
                continue
            if node < 0:
                yield ~node, at
                continue
            letter, cut, low, high = self.nodes[node]
            x = vectors[at, letter].astype(np.int16)
            over = x > cut
            left = ~over | ((x == cut + 1) & ~down & less)
            right = over | ((x == cut) & ~up)
            waiting += [(low, at[left], up[left], (down | over)[left]), (high, at[right], (up | ~over)[right], down[right])]

    def locate(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf whose box each vector is in."""
        out, waiting = np.zeros(len(vectors), np.int64), [(self.root, np.arange(len(vectors)))]
        while waiting:
            node, at = waiting.pop()
            if node < 0:
                out[at] = ~node
                continue
            letter, cut, low, high = self.nodes[node]
            below = vectors[at, letter] <= cut
            waiting += [(low, at[below]), (high, at[~below])]
        return out


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows differ by one replaced letter (same widths) or by one letter more."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (short != long).sum(1) == 1
    ahead = (short == long[:, :n]).cumprod(1, dtype=bool).sum(1)
    behind = (short == long[:, 1:])[:, ::-1].cumprod(1, dtype=bool).sum(1)
    return ahead + behind >= n


def pairs_of_group(members: np.ndarray, same: np.ndarray, shorter: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(kind, places in that kind, places in members) of near words: members with each other, and with queries of their length and of one letter less."""
    vectors = counts(members)
    tree = Tree(vectors, LEAF)
    for kind, rows, less, most in (("members", members, True, 2), ("same", same, True, 2), ("shorter", shorter, False, 1)):
        if not len(rows):
            continue
        asked = vectors if kind == "members" else counts(rows)
        step = max(1, (4 << 20) // max(rows.shape[1], 1))
        for leaf, at in tree.search(asked, less):
            there = tree.leaves[leaf]
            m = vectors[there].astype(np.float32)
            norms = (m * m).sum(1)
            for a in range(0, len(at), 8192):
                q = asked[at[a : a + 8192]].astype(np.float32)
                gap = (q * q).sum(1)[:, None] + norms - 2 * (q @ m.T)
                i, j = np.nonzero(gap <= most)
                i, j = at[a + i], there[j]
                if kind == "members":
                    i, j = i[i < j], j[i < j]
                for b in range(0, len(i), step):
                    x, y = i[b : b + step], j[b : b + step]
                    ok = one_edit(rows[x], members[y])
                    yield kind, x[ok], y[ok]


def _trees(words: DataFrame, total: int) -> dict[int, Tree]:
    """The upper tree of each length that a sample of all `total` words fills, with leaves of about GROUP words."""
    share = max(1, -(-total // SAMPLE))
    sample = words.where((F.length("word") <= LONG) & (F.pmod(F.xxhash64("word"), F.lit(share)) == 0)).select("word").toPandas()["word"]
    size = max(8, GROUP // share)
    return {int(n): Tree(counts(letters(part.sort_values().to_numpy())), size) for n, part in sample.groupby(sample.str.len()) if len(part) > size}


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, n): each word with each near word and that word's n; both directions. words: word, n, distinct."""
    total = words.count()
    trees = {n: (t.nodes, t.root) for n, t in _trees(words, total).items()}

    def tree(length: int) -> Tree:
        out = Tree(np.zeros((0, DIMS), np.uint8), 1)
        out.nodes, out.root = trees.get(length, ([], ~0))
        return out

    def dealt(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for length, part in pdf.groupby(pdf["word"].str.len()):
                vectors, out = counts(letters(part["word"].to_numpy())), []
                own, longer = tree(length), tree(length + 1)
                home = own.locate(vectors)
                out.append((np.arange(len(part)), length, home, 0))
                for leaf, at in own.search(vectors, True):
                    out.append((at[home[at] < leaf], length, leaf, 1))  # a pair is found from its lower leaf
                for leaf, at in longer.search(vectors, False):
                    out.append((at, length + 1, leaf, 2))
                at, *marks = (np.concatenate([np.broadcast_to(x[i], len(x[0])) for x in out]) for i in range(4))
                for a in range(0, len(at), ROWS):
                    b = slice(a, a + ROWS)
                    yield pd.DataFrame(dict(zip(("length", "leaf", "kind"), (m[b] for m in marks), strict=True)) | {"word": part["word"].to_numpy()[at[b]], "n": part["n"].to_numpy()[at[b]]})

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        length = int(pdf["length"].iloc[0])
        kinds = {k: pdf[pdf["kind"] == i] for i, k in enumerate(("members", "same", "shorter"))}
        found: list[pd.DataFrame] = []
        if len(kinds["members"]):
            rows = {k: letters(p["word"].to_numpy()) if len(p) else np.zeros((0, length), np.uint8) for k, p in kinds.items()}
            m = kinds["members"]
            for kind, i, j in pairs_of_group(*rows.values()):
                q = kinds[kind]
                for a, b in ((q.iloc[i], m.iloc[j]), (m.iloc[j], q.iloc[i])):
                    found.append(pd.DataFrame({"word": a["word"].to_numpy(), "other": b["word"].to_numpy(), "n": b["n"].to_numpy()}))
        return pd.concat(found) if found else pd.DataFrame({"word": pd.Series(dtype=str), "other": pd.Series(dtype=str), "n": pd.Series(dtype="int64")})

    tasks = max(8, total // GROUP)  # dealing is work of its own, however few bytes the words are
    rows = words.select("word", "n").repartition(tasks, "word").mapInPandas(dealt, "length int, leaf int, kind int, word string, n long")
    groups = sum(len(nodes) + 1 for nodes, _ in trees.values()) + 8  # a count, or small groups of much work would share tasks
    return rows.repartition(groups, "length", "leaf").groupBy("length", "leaf").applyInPandas(group, "word string, other string, n long")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word of each chain. A form is TIMES as frequent, so chains are short; each pass doubles the steps."""
    now = scratch(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = scratch(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = out.select("word", "root")
        if out.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", slips: bool = True) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word found twice or more, with its form and the root of its chain."""
    words = scratch(word_counts(docs, id_column, text_column, slips).where(F.col("n") >= TWICE), "words")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("other").alias("other")))  # largest n, then code-point order
    near = scratch(near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b")), "near")
    known = words.join(near, "word", "left").withColumn("form_n", -F.col("b.less"))
    known = scratch(known.withColumn("form", F.when(F.col("form_n") >= TIMES * F.col("n"), F.col("b.other"))).drop("b"), "known")
    discard(words, near)
    last = roots(known.where("form is not null"))
    out = known.join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: crc32 as a fold over bytes; pairs by strings with one letter left out.
OP11_SQL = r"""
WITH RECURSIVE steps AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT d, w, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
hexed AS (SELECT *, hex(encode(d || ':' || w)) AS x FROM runs),
hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8), 4294967295::BIGINT)) AS h FROM hexed, crcs),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word AS word, b.word AS other FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.s FROM less a JOIN words b ON a.s = b.word UNION SELECT a.s, a.word FROM less a JOIN words b ON a.s = b.word),
best AS (SELECT word, other, c, m FROM (SELECT e.word, e.other, w.n AS m, count(*) OVER (PARTITION BY e.word) AS c, row_number() OVER (PARTITION BY e.word ORDER BY w.n DESC, encode(e.other)) AS k FROM near e JOIN words w ON e.other = w.word) WHERE k = 1),
known AS (SELECT w.word, w.n, coalesce(c, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (SELECT word, word AS at FROM known UNION ALL SELECT w.word, k.form FROM walk w JOIN known k ON w.at = k.word WHERE k.form IS NOT NULL)
SELECT k.word, k.form, w.at AS root, k.n, CAST(k.n_near AS BIGINT) AS n_near, k.form_n FROM known k JOIN walk w ON k.word = w.word JOIN known e ON w.at = e.word WHERE e.form IS NULL
"""
