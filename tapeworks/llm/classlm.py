"""Language-model scoring (operator 6): a Brown class bigram model, trained by exchange clustering.

p(word | previous) = L * p(class | previous class) * p(word | class) + (1 - L) * p1(word), where
p1 is the add-one unigram estimate. A class keeps back the share of its words that were seen
once (Good and Turing's estimate) for unknown words; the rest goes to its known words by count. All
words that training does not have are one type, which every class emits with what it keeps back and
whose own class is not known: what follows it has the distribution of all classes. So the
probabilities of all known words and of the unknown one add up to 1 after any word.

1. Blocks: the documents' words, dictionary-coded in blocks of about `BLOCK_TOKENS` tokens. A
   block's dictionary has a word once, as a 64-bit hash, so that what is looked up or counted moves between tasks
   once for each block and word, not for each token. All later steps read the blocks.
2. Counts: over all training tokens, by word hash; the number of rows grows with the corpus.
3. A start: the `HEAD` most frequent words are units of their own; every other word belongs to one
   of `TAIL` units by its hash; the end is one. So the table of unit bigrams, counted over all
   training tokens, has at most (HEAD + TAIL + 1)^2 = 2048^2 cells, whatever the corpus. From units
   dealt by frequency, each unit moves to the class in which the bigram likelihood of the training
   text is highest, until no unit moves. The end keeps a class of its own.
4. Exchange over the whole vocabulary: each block sums up how often each of its words has which
   class before and after it; summed by word, these counts give the gain of the word in each class
   (to the first order) under the matrix of class bigrams, which is all that is broadcast. Every
   word of the training text, of the head or not, takes its best class, all at once (as in
   Uszkoreit and Brants, 2008). Sweeps go on while one raises the likelihood by `MIN_GAIN` of its
   value or more, `sweeps` at most; one that lowers it is taken back. The model has the likelihood before the
   first and after each (`likelihoods`), which shows how far the exchange has converged.
5. Scores: each block has the counts and classes of its dictionary and is scored in numpy.

Null and empty texts are one end token. Ids may repeat or be null: every row is scored, repeated
rows alike. With no training row, every probability is that of the unigram estimate, 1. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import discard, fold, from_key, id_key, scratch, table

BLOCK_TOKENS = 2_000_000
HEAD, TAIL = 2000, 47
BLOCKS_OF_TASK = 2
UNITS = HEAD + TAIL + 1
CLASSES = 64
#: Sweeps over the whole vocabulary, at most, and the share of the likelihood that one must gain to be followed by another.
SWEEPS = 1
MIN_GAIN = 0.001
LAMBDA = 0.9


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order (A-Z lower-cased, cut at ASCII white space), and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = split.flatten(), split.offsets.to_numpy()
    ends = ends - ends[0]
    real = pc.not_equal(flat, "")
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return flat.filter(real), np.diff(before[ends])


def blocks(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(block, hashes, train, ids, held, lengths, tokens): the documents in dictionary-coded blocks.

    hashes: the block's distinct words; tokens: little-endian u32, 0 for the end, k for
    hashes[k - 1]; train[k]: how often token k stands in training documents.
    """
    schema = pa.schema([("block", pa.int64()), ("words", pa.list_(pa.string())), ("train", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("tokens", pa.binary())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        flat, ids, held, lengths = [], [], [], []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal flat, ids, held, lengths, size, number
            coded = pa.concat_arrays(flat).dictionary_encode()
            n, out = np.concatenate(lengths) + 1, np.concatenate(held)
            tokens = np.zeros(n.sum(), "<u4")
            word = np.ones(len(tokens), bool)
            word[np.cumsum(n) - 1] = False
            tokens[word] = coded.indices.to_numpy() + 1
            train = np.bincount(tokens[np.repeat(~out, n)], minlength=len(coded.dictionary) + 1)
            lists = [coded.dictionary, pa.array(train, pa.int64()), pa.array(np.concatenate(ids), pa.int64()), pa.array(out), pa.array(n, pa.int32())]
            row = [pa.array([number], pa.int64()), *(pa.ListArray.from_arrays([0, len(x)], x) for x in lists), pa.array([tokens.tobytes()], pa.binary())]
            number, flat, ids, held, lengths, size = number + 1, [], [], [], [], 0
            return pa.RecordBatch.from_arrays(row, schema=schema)

        for batch in it:
            words, n = words_of(batch.column(2))
            ends = np.cumsum(n)
            a = 0
            while a < len(n):
                # as many whole documents as fit in what is left of the block, or one in an empty block
                room = BLOCK_TOKENS - size + (ends[a - 1] if a else 0)
                b = max(int(np.searchsorted(ends, room, side="right")), a)
                if b == a:
                    if size or ids:
                        yield flush()
                        continue
                    b = a + 1
                first, last = ends[a] - n[a], ends[b - 1]
                flat.append(words.slice(first, last - first))
                ids.append(batch.column(0)[a:b].to_numpy(zero_copy_only=False))
                held.append(batch.column(1)[a:b].to_numpy(zero_copy_only=False))
                lengths.append(n[a:b])
                size += int(last - first)
                a = b
        if ids:
            yield flush()

    rows = docs.select(id_key(id_column).alias("id"), held_out.alias("held"), F.col(text_column).cast("string").alias("text"))
    coded = rows.mapInArrow(batches, "block long, words array<string>, train array<long>, ids array<long>, held array<boolean>, lengths array<int>, tokens binary")
    return coded.select("block", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), "train", "ids", "held", "lengths", "tokens")


def dictionary(coded: DataFrame) -> DataFrame:
    """(block, token, h, n): the dictionary of each block, h the word's hash, n its count in training documents."""
    words = coded.select("block", "train", F.posexplode("hashes").alias("i", "h"))
    return words.select("block", (F.col("i") + 1).alias("token"), "h", F.get("train", F.col("i") + 1).alias("n"))


def unit_of(hashes: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Units of words by hash: their place in the sorted head hashes, or a tail unit."""
    if not len(head):
        return HEAD + hashes % TAIL
    at = np.minimum(np.searchsorted(head, hashes), len(head) - 1)
    return np.where(head[at] == hashes, at, HEAD + hashes % TAIL)


def unit_bigrams(coded: DataFrame, head: np.ndarray) -> DataFrame:
    """(pair, n): pair = previous unit * UNITS + unit, over training documents; each task adds up its own blocks first."""
    shared = coded.sparkSession.sparkContext.broadcast(head)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(UNITS * UNITS, np.int64)
        for pdf in it:
            for hashes, held, lengths, data in pdf.itertuples(index=False):
                units = np.concatenate(([UNITS - 1], unit_of(np.asarray(hashes, np.int64), shared.value)))
                seq = units[np.frombuffer(data, "<u4")]
                keep = np.repeat(~np.asarray(held, bool), np.asarray(lengths))
                # every document ends with the end unit, which is what its first word follows
                pairs = np.concatenate(([UNITS - 1], seq[:-1])) * UNITS + seq
                for a in range(0, len(pairs), 1 << 20):
                    total += np.bincount(pairs[a : a + (1 << 20)][keep[a : a + (1 << 20)]], minlength=len(total))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"pair": used.astype(np.int32), "n": total[used]})

    rows = coded.select("hashes", "held", "lengths", "tokens")
    return rows.mapInPandas(batches, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(n: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each unit, given how often one unit follows another; the last unit has the last class to itself.

    Sweeps go on until no unit moves; as each move raises the likelihood, they end. A move changes the likelihood of the class bigrams only; its gain is computed exactly, from
    the counts of the unit with each class, for all classes at once.
    """
    units, free = len(n), classes - 1
    order = np.argsort(-n.sum(axis=0)[: units - 1], kind="stable")
    cls = np.empty(units, np.int64)
    cls[order] = np.arange(units - 1) % free
    cls[units - 1] = free
    one = np.eye(classes)[cls]
    to, by = n @ one, n.T @ one  # unit to class; class to unit
    m = one.T @ to
    rows, cols = m.sum(axis=1), m.sum(axis=0)
    mass, self_ = n.sum(axis=1), n.diagonal()
    came = n.sum(axis=0)
    moved = 1
    while moved:
        moved = 0
        for u in order[came[order] > 0]:
            a = cls[u]
            out, in_, s = to[u].copy(), by[u].copy(), self_[u]
            m[a] -= out
            m[:, a] -= in_
            m[a, a] += s
            rows[a] -= mass[u]
            cols[a] -= came[u]
            out[a] -= s
            in_[a] -= s
            f = _phi(m)
            gain_out, gain_in = _phi(m + out) - f, _phi(m.T + in_) - f.T
            d = np.arange(classes)
            own = _phi(m[d, d] + out + in_ + s) - f[d, d]
            gain = gain_out.sum(axis=1) - gain_out[d, d] + gain_in.sum(axis=1) - gain_in[d, d] + own
            gain -= _phi(rows + mass[u]) - _phi(rows) + _phi(cols + came[u]) - _phi(cols)
            b = int(np.argmax(gain[:free]))
            if gain[b] <= gain[a] + 1e-9 * abs(gain[a]):
                b = a
            m[b] += out
            m[:, b] += in_
            m[b, b] += s
            rows[b] += mass[u]
            cols[b] += came[u]
            if b != a:
                cls[u] = b
                to[:, a] -= n[:, u]
                to[:, b] += n[:, u]
                by[:, a] -= n[u]
                by[:, b] += n[u]
                moved += 1
    return cls


def likelihood(m: np.ndarray) -> float:
    """The part of the log-likelihood of the training text that depends on the classes, given the counts of class bigrams."""
    return _phi(m).sum() - _phi(m.sum(axis=1)).sum() - _phi(m.sum(axis=0)).sum()


#: How often a word has a class after it (k: the class) or before it (k: CLASSES + the class); a count over 255 takes several records.
NEIGHBOUR = np.dtype([("k", "u1"), ("n", "u1")])


def cell_type(tokens: int) -> type[np.unsignedinteger]:
    """Holds the number of any of the 2 * CLASSES cells of each of so many tokens; the dictionary of one giant text may need 64 bits."""
    return np.uint32 if tokens * 2 * CLASSES <= 2**32 else np.uint64


def neighbours(rows: DataFrame, start: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(h, data): NEIGHBOUR records of each word of a block over its training documents; start: head and classes of units, for blocks without classes."""
    shared = rows.sparkSession.sparkContext.broadcast(start)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for hashes, held, lengths, data, c in pdf.itertuples(index=False):
                h = np.asarray(hashes, np.int64)
                mine = shared.value[1][unit_of(h, shared.value[0])] if c is None else np.frombuffer(c, "u1")[1:]
                cell = cell_type(len(mine) + 1)
                cls = np.concatenate(([CLASSES - 1], mine)).astype(cell)
                seq = np.frombuffer(data, "<u4").astype(cell, copy=False)
                before = np.concatenate((np.zeros(1, cell), seq[:-1]))
                keep = np.repeat(~np.asarray(held, bool), np.asarray(lengths))
                seq, before = seq[keep], before[keep]
                found = np.concatenate((before * cell(2 * CLASSES) + cls[seq], seq * cell(2 * CLASSES) + cell(CLASSES) + cls[before]))
                pairs, n = np.unique(found[found >= 2 * CLASSES], return_counts=True)
                several = (n + 254) // 255
                pairs = np.repeat(pairs.astype(np.int64), several)
                records = np.empty(len(pairs), NEIGHBOUR)
                records["k"], records["n"] = pairs % (2 * CLASSES), 255
                records["n"][np.cumsum(several) - 1] = n - 255 * (several - 1)
                words, at = np.unique(pairs // (2 * CLASSES), return_index=True)
                cuts, raw = np.append(at, len(pairs)) * NEIGHBOUR.itemsize, records.tobytes()
                for a in range(0, len(words), 50_000):
                    b = min(a + 50_000, len(words))
                    yield pd.DataFrame({"h": h[words[a:b] - 1], "data": [raw[cuts[i] : cuts[i + 1]] for i in range(a, b)]})

    c = F.lit(None).cast("binary").alias("c") if start is not None else F.col("c")
    return rows.select("hashes", "held", "lengths", "tokens", c).mapInPandas(batches, "h long, data binary")


def best_classes(found: DataFrame, m: np.ndarray, partitions: int) -> DataFrame:
    """(h, c): the class of each word under which the classes around it are most likely, given the counts m of class bigrams."""
    free = CLASSES - 1
    after = np.log(m + 0.1) - np.log(m.sum(axis=1, keepdims=True) + 0.1 * CLASSES)
    before = np.log(m + 0.1) - np.log(m.sum(axis=0, keepdims=True) + 0.1 * CLASSES)
    shared = found.sparkSession.sparkContext.broadcast(np.concatenate((after.T, before))[:, :free])

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None

        def chosen(h: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"h": h, "c": np.argmax(counts @ shared.value, axis=1).astype(np.int32)})

        for pdf in it:
            if not len(pdf):
                continue
            h, records = pdf["h"].to_numpy(np.int64), np.frombuffer(b"".join(pdf["data"]), NEIGHBOUR)
            new = np.append(True, h[1:] != h[:-1])
            owner = np.repeat(np.cumsum(new) - 1, [len(x) // NEIGHBOUR.itemsize for x in pdf["data"]])
            words = h[new]
            counts = np.bincount(owner * (2 * CLASSES) + records["k"], records["n"], len(words) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
            if last is not None and last == words[0]:
                counts[0] += held
            elif last is not None:
                yield chosen(np.array([last]), held[None])
            yield chosen(words[:-1], counts[:-1])
            last, held = words[-1], counts[-1].copy()
        if last is not None:
            yield chosen(np.array([last]), held[None])

    return found.repartition(partitions, "h").sortWithinPartitions("h").mapInPandas(batches, "h long, c int")


def known_blocks(coded: DataFrame, counts: DataFrame, hashes: bool, partitions: int) -> DataFrame:
    """(hashes, ids, held, lengths, tokens, n, c): the blocks with the training counts (<i8) and classes (u1) of their tokens, 0 for words that counts does not have; hashes are null unless asked for."""

    def joined(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples(index=False):
            n, c = np.zeros(row.size + 1, "<i8"), np.zeros(row.size + 1, "u1")
            n[right["token"]], c[right["token"]] = right["n"], right["c"]
            c[0] = CLASSES - 1
            out.append({"hashes": row.hashes, "ids": row.ids, "held": row.held, "lengths": row.lengths, "tokens": row.tokens, "n": n.tobytes(), "c": c.tobytes()})
        return pd.DataFrame(out, columns=["hashes", "ids", "held", "lengths", "tokens", "n", "c"])

    lookups = dictionary(coded).select("block", "token", "h").join(counts.select("h", "n", "c"), "h").select(F.col("block").alias("of_block"), "token", "n", "c")
    whole = coded.select(F.col("block").alias("in_block"), (F.col("hashes") if hashes else F.lit(None).cast("array<long>")).alias("hashes"), F.size("hashes").alias("size"), "ids", "held", "lengths", "tokens")
    out = whole.repartition(partitions, "in_block").groupBy("in_block").cogroup(lookups.repartition(partitions, "of_block").groupBy("of_block")).applyInPandas(joined, "hashes array<long>, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, n binary, c binary")
    return scratch(out, "known", free_shuffles=True)


def class_bigrams(rows: DataFrame) -> np.ndarray:
    """How often a class follows another in the training documents of blocks that have classes."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for pdf in it:
            for held, lengths, data, c in pdf.itertuples(index=False):
                seq = np.frombuffer(c, "u1")[np.frombuffer(data, "<u4")].astype(np.int64)
                keep = np.repeat(~np.asarray(held, bool), np.asarray(lengths))
                pairs = np.concatenate(([CLASSES - 1], seq[:-1])) * CLASSES + seq
                total += np.bincount(pairs[keep], minlength=len(total))
        yield pd.DataFrame({"pair": np.flatnonzero(total).astype(np.int32), "n": total[total > 0]})

    sums = rows.select("held", "lengths", "tokens", "c").mapInPandas(batches, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    m = np.zeros(CLASSES * CLASSES)
    m[sums["pair"].to_numpy()] = sums["n"].to_numpy()
    return m.reshape(CLASSES, CLASSES)


def train(coded: DataFrame, sweeps: int = SWEEPS) -> tuple[DataFrame, dict]:
    """(blocks with the counts and classes of their words, what else is needed to score them)."""
    # tasks grow in number with the blocks, so that what one reads does not grow with the corpus
    partitions = max(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-coded.count() // BLOCKS_OF_TASK))
    counts = scratch(dictionary(coded).where("n > 0").groupBy("h").agg(F.sum("n").alias("n")), "counts", free_shuffles=True)
    ends = coded.agg(F.sum(F.get("train", F.lit(0))).alias("n")).first()["n"] or 0
    top = counts.orderBy(F.desc("n"), "h").select("h").limit(HEAD).toPandas()["h"]
    head = np.sort(top.to_numpy(np.int64))
    pairs = unit_bigrams(coded, head).toArrow()  # at most UNITS * UNITS rows of twelve bytes
    bigrams = np.zeros(UNITS * UNITS)
    bigrams[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    del pairs
    bigrams = bigrams.reshape(UNITS, UNITS)
    cls = exchange(bigrams)
    one = np.eye(CLASSES)[cls]
    m = one.T @ bigrams @ one
    heads = F.broadcast(coded.sparkSession.createDataFrame(pd.DataFrame({"h": head, "c": cls[: len(head)]}), "h long, c int"))
    tail = F.get(F.array(*[F.lit(int(c)) for c in cls[HEAD : UNITS - 1]]), F.pmod("h", F.lit(TAIL)).cast("int"))
    classed = counts.select("h", "n").join(heads, "h", "left").select("h", "n", F.coalesce("c", tail).alias("c"))
    rows, found, reached = None, neighbours(coded, (head, cls)), [likelihood(m)]
    for k in range(sweeps):
        moved = scratch(counts.join(best_classes(found, m, partitions), "h"), "classes", free_shuffles=True)
        new = known_blocks(coded, moved, k + 1 < sweeps, partitions)
        m_new = class_bigrams(new)
        reached.append(likelihood(m_new))
        if reached[-1] <= reached[-2]:
            discard(new)
            break
        if rows is not None:
            discard(rows)
        rows, classed, m = new, moved, m_new
        if k + 1 < sweeps:
            found = neighbours(new)
        if reached[-1] - reached[-2] < MIN_GAIN * abs(reached[-2]):
            break
    if rows is None:
        rows = known_blocks(coded, classed, False, partitions)
    sums = classed.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).toPandas()
    n_class, once = np.zeros(CLASSES), np.zeros(CLASSES)
    n_class[sums["c"]], once[sums["c"]] = sums["n"], sums["once"]
    n_class[CLASSES - 1] += ends
    n, v = int(sums["n"].sum()) + int(ends), int(sums["v"].sum()) + (ends > 0)
    return rows, parameters(m, n_class, once) | {"n": n, "v": v, "ends": int(ends), "likelihoods": reached}


def parameters(m: np.ndarray, n_class: np.ndarray, once: np.ndarray) -> dict:
    """step: p(class | class before), with a last row for what follows an unknown word; unseen: what each class keeps back; n_class: tokens of each class."""
    unseen = np.where(n_class > 0, (once + 0.5) / (n_class + 1), 1.0)
    if n_class[-1] > 0:
        unseen[-1] = 0.0  # the end is known
    whole = np.vstack([m, m.sum(axis=0)]) + 0.1
    return {"step": whole / whole.sum(axis=1, keepdims=True), "unseen": unseen, "n_class": n_class}


def probabilities(model: dict, count: np.ndarray, cls: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(p1, p) of tokens with a training count and a class, after a token of class before; CLASSES is the class of unknown tokens (count 0)."""
    p1 = (count + 1) / (model["n"] + model["v"] + 1)
    if not model["n"]:
        return p1, p1
    known, c = count > 0, np.minimum(cls, len(model["unseen"]) - 1)
    emitted = model["step"][before, c] * (1 - model["unseen"][c]) * count / np.maximum(model["n_class"][c], 1)
    by_class = np.where(known, emitted, (model["step"] @ model["unseen"])[before])
    return p1, LAMBDA * by_class + (1 - LAMBDA) * p1


def scores(coded: DataFrame, known: DataFrame, model: dict) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document of known, which train made of coded."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def scored(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for row in (row for pdf in it for row in pdf.itertuples(index=False)):
            count = np.frombuffer(row.n, "<i8").astype(np.float64)
            count[0] = m["ends"]
            cls = np.where(count > 0, np.frombuffer(row.c, "u1"), CLASSES)
            seq = np.frombuffer(row.tokens, "<u4")
            lengths = np.asarray(row.lengths, np.int64)
            base, score = np.empty(len(seq)), np.empty(len(seq))
            for a in range(0, len(seq), 1 << 18):
                s = seq[a : a + (1 << 18)]
                # every document ends with the end, which is what its first word follows
                before = np.concatenate(([cls[seq[a - 1]] if a else cls[0]], cls[s[:-1]]))
                p1, p = probabilities(m, count[s], cls[s], before)
                base[a : a + len(s)], score[a : a + len(s)] = np.log10(p1), np.log10(p)
            starts = np.cumsum(lengths) - lengths
            known = np.add.reduceat((count > 0)[seq].astype(np.int64), starts)
            yield pd.DataFrame({"id": row.ids, "held_out": row.held, "n_tokens": lengths, "n_known": known, "train_tokens": m["n"], "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(score, starts)})

    return known.mapInPandas(scored, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = scratch(blocks(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2), "blocks")
    known, model = train(coded)
    out = scores(coded, known, model)
    return out.select(from_key("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
