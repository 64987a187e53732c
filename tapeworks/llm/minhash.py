"""Near duplicates (operator 7): ProbMinHash, banding, verification, components.

Each text is its shingles of five lower-cased words, weighted by how often they stand in it.
Every shingle emits the arrivals of a Poisson process whose rate is its weight, from random bits
that depend on the shingle alone; each arrival falls into a random one of `REGISTERS` registers,
and the earliest arrival of a register wins. Two texts have the same winner in a register with
the probability Jaccard of their weighted shingles. Arrivals later than the time by which all
registers are filled are never made (early termination): a text makes about m ln m arrivals,
however long it is.

Weights are used in two forms, and each form is sketched and verified as the same measure: the
counts, and ones (with which the probability Jaccard is the Jaccard similarity of the sets). A
text without repeated shingles has both forms in one sketch; another text has two sketches.
`BANDS` bands of `ROWS` registers of each sketch give candidates; texts of similarity 0.8 in
either form share a band with probability 1 - 2e-5. Candidates are verified exactly: one of the
two similarities must reach `THRESHOLD`. Equal texts (same words in the same order) form a class
first, so that copies become one row; classes have numbers of their own, as an id may be null or
repeat with other texts. The class's representative is its row of the smallest id.

No pairs are made within a bucket: each text is compared with the smallest number of its bucket (the
hub), then components are found. Any two texts of a bucket are then both partners of its hub, so
only a hub's partners that are in different components are left to compare. Of those, a text can
have a link only if its shingles that texts of other components hold too weigh 0.8 or more of it
(the shared weight bounds both similarities from above); this is counted by shingle, and texts
that fall short go. What is left meets in a task in blocks, as matrices, and a task emits links that join
components, not pairs. No link between candidates is lost, and a group of n near copies that link
to their hub, or of n texts of a template with words of their own, costs n comparisons.
Counts aggregate before they shuffle; joins on hot keys are equi-joins of two
shuffled sides, which Spark splits when skewed.

A text without a word is in no group: its class is its own id. Texts of fewer than five words
are one shingle. A null id is a document like others, and the smallest id. Repeated rows are
copies; different texts that share an id are grouped each for itself, so that two groups may have
one smallest id (and class id). An empty table gives no rows. Columns of any name and type are
carried along by `dedup`, and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import boxed, discard, from_key, id_key, inside, runs_of_chars, scratch, table
from tapeworks.llm.shingles import digest, mix, normalise, shingle_hashes

BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
THRESHOLD = 0.8
SLACK = 5.0
#: Distinct shingles that are sketched together, about.
TOGETHER = 200_000
#: Texts of a block when texts of a group are compared with each other.
BLOCK = 256
#: Bits of the filter that keeps most other texts out of the shuffle of candidates: 8 MB, whatever the input.
FILTER_BITS = 1 << 26


def registers(hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """For each text and register the hash of the shingle whose arrival comes first.

    hashes and weights have the distinct shingles of all texts, one text after another; sizes
    says how many each has, one at least.
    """
    n = len(sizes)
    text = np.repeat(np.arange(n), sizes)
    total = np.add.reduceat(weights, np.cumsum(sizes) - sizes)
    limit = m * (np.log(m) + SLACK) / total
    best, winner = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    open_ = np.ones(n, bool)
    with np.errstate(over="ignore"):
        while open_.any():
            mine = open_[text]
            h, rate, t = hashes[mine], weights[mine].astype(np.float64), text[mine]
            state, now = h, np.zeros(len(h))
            while len(h):
                state = mix(state + np.uint64(0x9E3779B97F4A7C15))
                now = now - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
                alive = now <= limit[t]
                state, rate, now, h, t = state[alive], rate[alive], now[alive], h[alive], t[alive]
                at = t * m + (mix(state ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m)).astype(np.int64)
                np.minimum.at(best, at, now)
                first = now == best[at]
                winner[at[first]] = h[first]
            open_ = ~np.isfinite(best.reshape(n, m)).all(axis=1)
            limit = limit * 2  # the few texts with an empty register once more, from the start
    return winner.reshape(n, m)


def band_keys(winner: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys for each row of winners."""
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(winner), BANDS))
        for k in range(ROWS):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ winner.reshape(-1, BANDS, ROWS)[:, :, k])
        return out.view(np.int64)


def row_key(id_: Column, text: Column) -> dict[str, Column]:
    """What tells a row from rows of other ids or other texts, by 64-bit hash and length of the text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return {"id": id_key(id_), "hash": F.xxhash64(text), "length": F.length(text)}


def sketched_texts(normals: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each text: the band keys of its sketches, its number of distinct shingles, and whether one repeats."""
    bands, n, repeats = [np.zeros(0, np.int64)] * len(normals), np.zeros(len(normals), np.int32), np.zeros(len(normals), bool)
    for a, b in runs_of_chars([len(t) // 6 for t in normals], TOGETHER):
        owner, found = [], []
        for i in range(a, b):
            if normals[i]:
                hashes, counts = np.unique(shingle_hashes(normals[i]), return_counts=True)
                n[i], repeats[i] = len(hashes), counts.max() > 1
                for weights in (np.ones_like(counts), counts)[: 1 + int(repeats[i])]:
                    owner.append(i)
                    found.append((hashes, weights))
        if found:
            keys = band_keys(registers(np.concatenate([x for x, _ in found]), np.concatenate([w for _, w in found]), np.array([len(x) for x, _ in found])))
            for i, k in zip(owner, keys, strict=True):
                bands[i] = np.union1d(bands[i], k) if len(bands[i]) else k
    return bands, n, repeats


def sketches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, hash, length, digest, n, repeats, bands) of each row: its row_key, digest of the normalised text (null without a word), and what `sketched_texts` finds."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            normals = [normalise(t) for t in pdf["text"]]
            bands, n, repeats = sketched_texts(normals)
            yield pd.DataFrame({"id": pdf["id"], "hash": pdf["hash"], "length": pdf["length"], "digest": [digest(t) if t else None for t in normals], "n": n, "repeats": repeats, "bands": bands})

    rows = docs.select(*[c.alias(k) for k, c in row_key(F.col(id_column), F.col(text_column)).items()], F.col(text_column).cast("string").alias("text"))
    return rows.mapInPandas(batches, "id long, hash long, length int, digest binary, n int, repeats boolean, bands array<long>")


def likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ids, and a few others: those whose hashed id has a bit in a bitmap of the hashed ids.

    The bitmap is broadcast; it never has more than `FILTER_BITS` bits, in rows of 4 KB. The more
    ids there are, the more other rows stay, so an exact join follows.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1
    bitmaps = ids.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(bitmaps), (F.bitmap_bucket_number(bit) == F.col("part")) & is_set, "left_semi")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, set, counts) of the texts that ids (id: a row_key, k: the id to return) names, one row an id: the sorted distinct shingle hashes, as bytes, and how often each stands (u4; null if all stand once)."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [np.unique(shingle_hashes(normalise(t)), return_counts=True) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "set": [x.tobytes() for x, _ in found], "counts": [c.astype("<u4").tobytes() if (c > 1).any() else None for _, c in found]})

    rows = docs.select(F.struct(*[c.alias(k) for k, c in row_key(F.col(id_column), F.col(text_column)).items()]).alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = likely(rows, ids).join(ids, "id").dropDuplicates(["id"]).select(F.col("k").alias("id"), "text")
    return rows.mapInPandas(batches, "id long, set binary, counts binary")


def weighted(set_: bytes, counts: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their shares of the text's weight, by count."""
    x = np.frombuffer(set_, np.uint64)
    w = np.ones(len(x)) if counts is None else np.frombuffer(counts, "<u4").astype(np.float64)
    return x, w / w.sum()


def probability_jaccard(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> float:
    """Sum over common elements k of 1 / sum over all y of max(p_y / p_k, q_y / q_k); x and y are sorted."""
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    # an element counts with p where its ratio q / p is at most that of k, else with q
    ratio = q[j] / p[i]
    order = np.argsort(ratio, kind="stable")
    ratio, pk, qk = ratio[order], p[i][order], q[j][order]
    last = np.searchsorted(ratio, ratio, side="right")
    below = (1 - pk.sum()) + np.concatenate(([0.0], np.cumsum(pk)))[last]
    above = 1 - np.concatenate(([0.0], np.cumsum(qk)))[last]
    return float((1 / (below / pk + above / qk)).sum())


def similar(x: bytes, cx: bytes | None, y: bytes, cy: bytes | None, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sets, or the probability Jaccard by their counts, is threshold or more."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if min(len(a), len(b)) >= threshold * max(len(a), len(b)):
        both = len(np.intersect1d(a, b, assume_unique=True))
        if both > 0 and both >= threshold * (len(a) + len(b) - both):
            return True
    if cx is None and cy is None:
        return False
    return probability_jaccard(*weighted(x, cx), *weighted(y, cy)) >= threshold - 1e-12


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) that are similar by their exact weights."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, cx: pd.Series, y: pd.Series, cy: pd.Series) -> pd.Series:
        return pd.Series([similar(*row, threshold) for row in zip(x, cx, y, cy, strict=True)], dtype=bool)

    joined = pairs
    for end in ("a", "b"):
        joined = joined.join(sets.select(F.col("id").alias(end), F.col("set").alias(f"set_{end}"), F.col("counts").alias(f"counts_{end}")), end)
    return joined.where(alike("set_a", "counts_a", "set_b", "counts_b")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in links (a, b): the smallest id of its component.

    Rounds of: take the smallest label of the neighbours, then that label's own label. A round
    at least doubles the distance over which labels travel along a chain of labels.
    """
    both = scratch(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = scratch(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        lower = scratch(lower, "lower")  # a table, so that the join on the label of a large component can be split
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = lower.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        new = scratch(new, "labels")
        ended = new.where(F.col("label") < F.col("old")).isEmpty()
        discard(labels, lower)
        labels = new.select("id", "label")
        if ended:
            discard(both)
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) after more links (a, b): only the labels that the links join are looked at, not all links before."""
    of = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
    ends = links.join(of, "a", "left").join(of.withColumnsRenamed({"a": "b", "la": "lb"}), "b", "left")
    met = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a != b"))
    moved = labels.join(met.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    out = scratch(moved.unionByName(met.join(labels, "id", "left_anti").select("id", "label")), "labels")
    discard(met)
    return out


def members_of(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(hub, hub_label, id, label) of the partners of hubs, in groups whose partners have several labels."""
    rows = pairs.select(F.col("a").alias("hub"), F.col("b").alias("id")).join(labels, "id", "left").select("hub", "id", F.coalesce("label", "id").alias("label"))
    rows = rows.join(labels.select(F.col("id").alias("hub"), F.col("label").alias("hub_label")), "hub", "left").withColumn("hub_label", F.coalesce("hub_label", "hub"))
    groups = scratch(mixed(rows), "groups")
    out = scratch(rows.join(groups.select("hub"), "hub", "left_semi"), "members")
    discard(groups)
    return out


def linkable(members: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The members (hub, hub_label, id, label) that may be similar to a text of another label.

    Of two texts the shared shingles bound their similarity: it is at most what the shared ones
    weigh in either text, by ones and by counts. So a text goes whose shingles that are also in
    texts of other labels weigh less than threshold. Counted by shingle, not by pair.
    """

    def shares(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples(index=False):
                x, p = weighted(row.set, row.counts)
                yield pd.DataFrame({"id": row.id, "label": row.label, "shingle": x.view(np.int64), "one": 1 / len(x), "share": p})

    texts = members.select("id", "label").distinct().join(sets, "id").select("id", "label", "set", "counts")
    rows = texts.mapInPandas(shares, "id long, label long, shingle long, one double, share double")
    common = rows.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
    held = rows.join(common, "shingle", "left_semi").groupBy("id").agg(F.greatest(F.sum("one"), F.sum("share")).alias("held"))
    return members.join(held.where(F.col("held") >= threshold - 1e-9).select("id"), "id", "left_semi")


def mixed(members: DataFrame) -> DataFrame:
    """(hub, rest, home): the groups that have texts of several labels, and into how many blocks those of other labels than the hub's, and those of its label, are dealt."""
    home = F.col("label") == F.col("hub_label")
    sizes = [F.ceil(F.count_if(c) / BLOCK).cast("int").alias(name) for name, c in (("rest", ~home), ("home", home))]
    return members.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high"), *sizes).where("low < high").select("hub", "rest", "home")


def compared(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) between texts of a group that are not yet in one component.

    rows: hub (the group), hub_label, id, label, set, counts, rest, home (how many blocks its group is dealt
    into). A task holds two blocks of at most about BLOCK texts, one of which has texts that are not in the
    hub's component (texts of that component are not compared with each other, so a few
    texts outside a large component meet it once). It computes the overlaps of their texts as a
    product of incidence matrices, and emits only links that join labels: no row is made for a
    pair as such.
    """
    at_home = F.col("label") == F.col("hub_label")
    mine = F.pmod(F.xxhash64("id"), F.when(at_home, F.col("home")).otherwise(F.col("rest"))).cast("int") + F.when(at_home, F.col("rest")).otherwise(0)
    others = F.sequence(F.lit(0), F.when(at_home, F.col("rest")).otherwise(F.col("rest") + F.col("home")) - 1)
    dealt = rows.select("hub", "id", "label", "set", "counts", mine.alias("block"), F.explode(others).alias("k"))
    dealt = dealt.select("hub", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "id", "label", "set", "counts")

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for pdf in it:
            out = []
            for row in pdf.itertuples(index=False):
                if (row.hub, row.i, row.j) != now:
                    out += _links(held, threshold)
                    now, held = (row.hub, row.i, row.j), []
                held.append(row)
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        yield pd.DataFrame(_links(held, threshold), columns=["a", "b"], dtype=np.int64)

    return dealt.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "id").mapInPandas(batches, "a long, b long")


def _links(held: list, threshold: float) -> list[tuple[int, int]]:
    """Links between texts of one pair of blocks, as few as join all labels that links join."""
    left = [n for n, r in enumerate(held) if r.block == r.i]
    right = left if held and held[0].i == held[0].j else [n for n, r in enumerate(held) if r.block == r.j]
    if not left or not right or len({r.label for r in held}) < 2:
        return []
    texts = [weighted(r.set, r.counts) for r in held]
    size = np.array([len(x) for x, _ in texts], np.float64)
    owner = np.repeat(np.arange(len(held)), size.astype(np.int64))
    values, shingle, counts = np.unique(np.concatenate([x for x, _ in texts]), return_inverse=True, return_counts=True)
    keep = counts[shingle] > 1
    shared = np.flatnonzero(counts > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    owner, shingle, share = owner[keep], column[shingle[keep]], np.concatenate([p for _, p in texts])[keep]
    order = np.argsort(shingle, kind="stable")
    owner, shingle, share = owner[order], shingle[order], share[order]
    # shingles in common, and what they weigh by count in the left and in the right text
    both, of_left, of_right = (np.zeros((len(left), len(right)), np.float32) for _ in range(3))
    counted = any(r.counts is not None for r in held)
    for a in range(0, len(shared), 4096):
        lo, hi = np.searchsorted(shingle, [a, a + 4096])
        m = np.zeros((len(held), min(4096, len(shared) - a)), np.float32)
        m[owner[lo:hi], shingle[lo:hi] - a] = 1
        both += m[left] @ m[right].T
        if counted:
            w = np.zeros_like(m)
            w[owner[lo:hi], shingle[lo:hi] - a] = share[lo:hi]
            of_left += w[left] @ m[right].T
            of_right += m[left] @ w[right].T
    fits = both >= threshold * (size[left][:, None] + size[right][None, :] - both)
    if counted:
        fits |= np.minimum(of_left, of_right) >= threshold - 1e-4
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for p, q in zip(*np.nonzero(fits), strict=True):
        x, y = held[left[p]], held[right[q]]
        a, b = find(x.label), find(y.label)
        if a != b and similar(x.set, x.counts, y.set, y.counts, threshold):
            root[max(a, b)] = min(a, b)
            out.append((min(x.id, y.id), max(x.id, y.id)))
    return out


def grouped(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(the sketches of docs; d, rep, low of each digest d: the row_key of the text's smallest id, and that of the smallest id of its group)."""
    sketched = scratch(sketches(docs, id_column, text_column), "sketches")
    # rows of one digest have the same shingles, whatever their id
    of_text = sketched.where("digest is not null").groupBy("digest").agg(F.min(F.struct("id", "hash", "length")).alias("rep"), F.first("n").alias("n"), F.first("repeats").alias("repeats"), F.first("bands").alias("bands"))
    classes = scratch(of_text.withColumn("k", F.monotonically_increasing_id()), "classes")
    # texts without repeated shingles have both weights in one, so their sizes bound the similarity; 0 stands for no such bound
    reps = classes.select(F.col("k").alias("id"), F.when(F.col("repeats"), 0).otherwise(F.col("n")).alias("n"), F.explode("bands").alias("bucket"))
    hub = F.min(F.struct("id", "n")).alias("hub")
    hubs = scratch(reps.groupBy("bucket").agg(hub, F.count("*").alias("texts")).where("texts > 1").select("bucket", F.col("hub.id").alias("a"), F.col("hub.n").alias("na")), "hubs")
    pairs = scratch(reps.join(hubs, "bucket").where("id != a").select("a", "na", F.col("id").alias("b"), F.col("n").alias("nb")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct()
    wanted = scratch(classes.join(wanted, "k", "left_semi").select(F.col("rep").alias("id"), "k"), "wanted")
    sets = scratch(shingle_sets(docs, wanted, id_column, text_column), "sets")
    near = (F.least("na", "nb") == 0) | (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    links = scratch(verified(pairs.where(near).select("a", "b"), sets, threshold), "links")
    labels = components(links)
    # two texts of a bucket were both compared with its hub: what is left is inside the hubs' groups
    members = members_of(pairs, labels)
    members, all_ = scratch(linkable(members, sets, threshold), "linkable"), members
    discard(all_)
    more = scratch(compared(members.join(scratch(mixed(members), "groups"), "hub").join(sets, "id"), threshold).distinct(), "more")
    if not more.isEmpty():
        labels, before = joined(labels, more), labels
        discard(before)
    linked = scratch(labels.join(classes.select("k", "rep"), F.col("id") == F.col("k")).select("k", "rep", "label"), "linked")
    low = scratch(linked.groupBy("label").agg(F.min("rep").alias("low")), "low")
    lows = linked.select("k", "label").join(low, "label").select("k", "low")
    by_text = classes.join(lows, "k", "left").select(F.col("digest").alias("d"), "rep", F.coalesce("low", "rep").alias("low"))
    by_text = scratch(by_text, "by_text")
    discard(classes, hubs, pairs, wanted, sets, links, labels, members, more, linked, low)
    return sketched, by_text


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id) for every row of docs: the smallest id of its group, the row's own id if it is alone."""
    sketched, by_text = grouped(docs, id_column, text_column, threshold)
    out = sketched.select("id", "digest").join(by_text.select("d", F.col("low.id").alias("class_id")), F.col("digest") == F.col("d"), "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"))


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each group: that of the smallest id (of several texts with this id, one). Columns as in docs; rows without a word all stay."""
    sketched, by_text = grouped(docs, id_column, text_column, threshold)
    one = by_text.where(F.col("rep") == F.col("low")).select("rep.*").withColumn("one", F.lit(True))
    all_ = sketched.where("digest is null").select("id", "hash", "length").distinct().withColumn("one", F.lit(False))
    keys = row_key(inside(id_column), inside(text_column))
    kept = boxed(docs).withColumns(keys).join(one.unionByName(all_), list(keys))
    kept = kept.withColumn("copy", F.when(~F.col("one"), F.monotonically_increasing_id()))
    return kept.dropDuplicates([*keys, "copy"]).select("row.*")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(from_key("id").alias("doc_id"), from_key("class_id").alias("class_id"))
