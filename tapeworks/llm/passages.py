"""Repeated passages (operator 3): depth-limited radix sort of suffixes.

Two suffixes of equal first `depth` bytes begin the same repeated window, so suffixes need to be
ordered through `depth` bytes only: by passes over digits, most significant first, each of which
drops what is alone in its group. After the last pass equal groups are the repeated windows.

Suffixes travel in bundles: a record (about one for 55 bytes of text) of ids and digests, not of text, stands for up to
`WIDTH` neighbouring suffixes. So that equal suffixes are in like bundles, bundles are cut at
anchors: the anchor of a window is the least (by hash) of the `KEY`-byte strings that start in its
first depth - KEY + 1 places, the first of equals; equal windows have the same anchor at the same
offset, and a bundle has the suffixes of one anchor whose offsets are in one block of `WIDTH`. Its digits
are what its suffixes share of theirs: through byte 200 of the suffix, then through 300, then through
400. Each of the three passes compares them by one digit more, and a bundle that is alone in its
group ends.

After the last pass the groups, whose bundles agree through byte 400, are settled by their spans, the bytes of all
their windows: a span found twice settles it, since then each of its windows is found twice; where a group has
other spans as well, one bundle of each is cut into narrower ones, of 16
suffixes and then of one, in which digits, span and window are the same, and those are compared in the same way.
Hot groups (a passage that a third of the texts share) cost partial counts: a group is never
gathered, only counted, and joined back by key. With the logger of this module at INFO each pass reports its rows and groups.

Spans are equal if 128 bits of BLAKE2b of their bytes are, within groups that are equal too. Matches
never cross documents.

Passages of over 50 words may be shorter than `DEPTH` bytes. They are found in the same way, with words for bytes: the
windows of `WORDS` words of one anchor (a string of `WORD_KEY` words) are a bundle, which goes on if another document has the
anchor; a span that two documents share settles its windows, and the windows of the other spans are compared one by one.
Here a window counts if another document has it too (white space between words is not compared), and nothing is cut.

A null or empty text has no bytes, and a text shorter than depth
none to remove. Equal rows count as two documents, so all of a repeated row's windows are
repeated. Kept bytes may not be valid UTF-8 by themselves; they are bytes. An empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import discard, from_key, id_key, runs_of_chars, scratch, table
from tapeworks.llm.shingles import BASE, BYTE, INVERSE, mix, powers

DEPTH = 400
KEY = 100
#: Offsets of a bundle, and the bytes through which the passes order suffixes, one digit a pass.
WIDTH = 128
DIGITS = (200, 300, DEPTH)
#: Offsets of the bundles into which those are cut that agree through the last digit and differ in their spans.
NARROWER = (16, 1)
PART = 1 << 20
#: Words of the shortest passage of over 50 words, and of the strings that may be its anchor.
WORDS = 51
WORD_KEY = 8
#: Bytes of texts that are taken together, about.
TOGETHER = 1 << 17
#: The six white-space characters of ASCII, by byte.
SPACE = np.isin(np.arange(256), (32, *range(9, 14)))

log = logging.getLogger(__name__)


def anchors(sums: np.ndarray, depth: int = DEPTH, key: int = KEY) -> tuple[np.ndarray, ...]:
    """(first, last, anchor): ranges of window starts in a text, given its prefix_sums, that have the same anchor, and the anchor's place."""
    n = len(sums) - 1
    if n < depth:
        return (np.zeros(0, np.int64),) * 3
    h = string_hashes(sums, key)
    width = depth - key + 1
    # least of each run of width hashes, and the first place with it: minima from the left and from the right of blocks of that width
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[: len(h)] = h
    grid, place = padded.reshape(blocks, width), np.arange(blocks * width).reshape(blocks, width)
    left, right = np.minimum.accumulate(grid, axis=1), np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    less, least = np.ones(grid.shape, bool), np.ones(grid.shape, bool)
    np.less(grid[:, 1:], left[:, :-1], out=less[:, 1:])
    np.less_equal(grid[:, :-1], right[:, 1:], out=least[:, :-1])
    left_at = np.maximum.accumulate(np.where(less, place, 0), axis=1).ravel()
    right_at = np.minimum.accumulate(np.where(least, place, blocks * width)[:, ::-1], axis=1)[:, ::-1].ravel()
    starts, ends = slice(0, n - depth + 1), slice(width - 1, n - depth + width)
    at = np.where(right.ravel()[starts] <= left.ravel()[ends], right_at[starts], left_at[ends])
    changes = np.flatnonzero(at[1:] != at[:-1])
    first = np.concatenate(([0], changes + 1))
    return first, np.concatenate((changes, [len(at) - 1])), at[first]


def sums_of(values: np.ndarray) -> np.ndarray:
    """Of each prefix of values a sum from which the hash of any string in it follows."""
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers(BASE, len(values)))))


def prefix_sums(raw: bytes) -> np.ndarray:
    """`sums_of` the bytes of raw."""
    return sums_of(BYTE[np.frombuffer(raw, np.uint8)])


def string_hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each string of this length in a text, given its prefix_sums."""
    with np.errstate(over="ignore"):
        return mix((sums[length:] - sums[:-length]) * powers(INVERSE, len(sums))[: len(sums) - length])


def suffix_digits(raw: bytes) -> tuple[np.ndarray, ...]:
    """(first, last, anchor, digits) of the bundles of a text: ranges of window starts in a block of offsets of one anchor, and a column a digit: the hash of what they share of their bytes through it."""
    sums = prefix_sums(raw)
    first, last, anchor = anchors(sums)
    if not len(first):
        return first, last, anchor, np.zeros((0, len(DIGITS)), np.int64)
    low, high = anchor - last, anchor - first
    n = high // WIDTH - low // WIDTH + 1
    at = np.repeat(np.arange(len(n)), n)
    block = low[at] // WIDTH + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    near, far = np.maximum(block * WIDTH, low[at]), np.minimum(block * WIDTH + WIDTH - 1, high[at])
    start = anchor[at] - block * WIDTH
    with np.errstate(over="ignore"):
        place, shift = block.astype(np.uint64) * np.uint64(BASE), powers(INVERSE, len(sums))[start]
        digits = [mix(mix((sums[start + depth - WIDTH + 1] - sums[start]) * shift) + place) for depth in DIGITS]
    return anchor[at] - far, anchor[at] - near, anchor[at], np.stack(digits, axis=1).view(np.int64)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of a text: 64 bits each, and its first byte; the sums of bytes are held for `PART` bytes at a time."""
    space = np.concatenate(([True], SPACE[np.frombuffer(raw, np.uint8)], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])  # where words start and end, in turn
    sums, shifts, before = np.zeros(len(edges), np.uint64), np.zeros(len(edges), np.uint64), np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(raw) + 1, PART):
            inside = slice(*np.searchsorted(edges, (a, a + PART)))
            piece, place = prefix_sums(raw[a : a + PART]), np.uint64(pow(BASE, a, 2**64))
            sums[inside] = before + place * piece[edges[inside] - a]
            shifts[inside] = np.uint64(pow(INVERSE, a, 2**64)) * powers(INVERSE, PART)[edges[inside] - a]
            before = before + place * piece[-1:]
        return mix((sums[1::2] - sums[::2]) * shifts[::2]), edges[::2]


def word_bundles(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, at, core, span) of the bundles of texts: number of the text, place in it, hash of the anchor, hash of the words of all windows."""
    words, starts = word_hashes(b" ".join(texts))
    # the first word of each text; windows that begin in one text and end in another are none
    begin = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    out = []
    for start in range(0, max(1, len(words) - WORDS + 1), PART):
        sums = sums_of(words[start : start + PART + WORDS - 1])
        first, last, anchor = anchors(sums, WORDS, WORD_KEY)
        text = np.searchsorted(begin, anchor + start, "right") - 1
        first, last = np.maximum(first, begin[text] - start), np.minimum(last, begin[text + 1] - WORDS - start)
        whole = first <= last
        first, last, anchor, text = first[whole], last[whole], anchor[whole], text[whole]
        back = powers(INVERSE, len(sums))
        with np.errstate(over="ignore"):
            core = mix((sums[anchor + WORD_KEY] - sums[anchor]) * back[anchor])
            span = mix(mix((sums[last + WORDS] - sums[first]) * back[first]) + packed(last - first, 0, anchor - first).astype(np.uint64) * np.uint64(BASE))
        out.append((text, packed(first + start - begin[text], last - first + 1, anchor - first), core.view(np.int64), span.view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def parts(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(start, bytes) of overlapping parts of a long text; each window stands whole in one."""
    for a in range(0, max(1, len(raw) - DEPTH + 1), PART):
        yield a, raw[a : a + PART + DEPTH - 1]


def digest(head: int, data: bytes, size: int = 16) -> bytes:
    """BLAKE2b of data and of a number. Spans are held to be equal by 128 bits of it, within cores equal by 64 bits more."""
    return hashlib.blake2b(data, digest_size=size, salt=head.to_bytes(4, "little")).digest()


def packed(first: np.ndarray | int, n: np.ndarray | int, offset: np.ndarray | int) -> np.ndarray | int:
    """A bundle's place as one integer: first window, number of windows, offset of the anchor from the first."""
    return (first << 18) | (n << 9) | offset


def unpacked(at: np.ndarray | int) -> tuple[np.ndarray | int, ...]:
    return at >> 18, (at >> 9) & 511, at & 511


ROW = "id long, text_hash long, at long, core long, span long, span2 long, settled boolean"
SPAN = ["core", "span", "span2"]
#: The digits of the bundles of the first pass. The last, through byte `DEPTH`, is their core.
THROUGH = [*(f"through_{depth}" for depth in DIGITS[:-1]), "core"]


def bundles(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The bundles of the first pass, as `ROW` and the digits before the core; span is the digest of all windows' bytes."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for key, text_hash, text in pdf.itertuples(index=False):
                for start, raw in parts(text.encode("utf-8", "surrogatepass")):
                    first, last, anchor, digits = suffix_digits(raw)
                    if len(first):
                        spans = b"".join([digest(m - a, raw[a : b + DEPTH]) for a, b, m in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True)])
                        out.append((key, text_hash, packed(first + start, last - first + 1, anchor - first), np.concatenate((digits, np.frombuffer(spans, "<i8").reshape(-1, 2)), axis=1)))
            if out:
                sizes, hashes = [len(x[2]) for x in out], np.concatenate([x[3] for x in out])
                ids = {"id": np.repeat([x[0] for x in out], sizes), "text_hash": np.repeat([x[1] for x in out], sizes), "at": np.concatenate([x[2] for x in out])}
                yield pd.DataFrame(ids | {c: hashes[:, i] for i, c in enumerate([*THROUGH, "span", "span2"])} | {"settled": False})

    text = F.col(text_column).cast("string")
    rows = docs.select(id_key(id_column).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).where(F.octet_length("text") >= DEPTH)
    return rows.mapInPandas(batches, "id long, text_hash long, at long, " + "".join(f"{c} long, " for c in THROUGH) + "span long, span2 long, settled boolean")


def ordered(texts: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """The bundles of width offsets into which those of reps (id, text_hash, at, settled) fall, with their digits through byte `DEPTH`, as `ROW`."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for key, text_hash, text, held in pdf.itertuples(index=False):
                raw = _expand(text)
                for one in held:
                    first, n, offset = unpacked(one["at"])
                    m, low, high = first + offset, offset - n + 1, offset
                    for block in range(low // width, high // width + 1):
                        d0, d1 = block * width, block * width + width - 1
                        a, b = m - min(d1, high), m - max(d0, low)
                        core, span = digest(block, raw[m - d0 : m - d1 + DEPTH], 8), digest(m - a, raw[a : b + DEPTH])
                        out.append((key, text_hash, packed(a, b - a + 1, m - a), *(int.from_bytes(x, "little", signed=True) for x in (core, span[:8], span[8:])), one["settled"]))
            if out:
                yield pd.DataFrame(out, columns=["id", "text_hash", "at", *SPAN, "settled"])

    by_text = reps.groupBy("id", "text_hash").agg(F.collect_set(F.struct("at", "settled")).alias("held"))
    rows = texts.join(by_text, ["id", "text_hash"]).select("id", "text_hash", "bytes", "held")
    return rows.mapInPandas(batches, ROW)


def sort_pass(rows: DataFrame, digit: str) -> DataFrame:
    """The rows of a table that are not alone in their group by this digit, as a table; a group of settled rows alone ends too."""
    groups = rows.groupBy(digit).agg(F.count("*").alias("n"), F.count_if(~F.col("settled")).alias("unsettled")).where("n > 1 and unsettled > 0").select(digit)
    groups = scratch(groups, "groups")  # a table, so that the join on a hot group can be split
    alive = scratch(rows.join(groups, digit, "left_semi"), "alive")
    if log.isEnabledFor(logging.INFO):
        log.info("%s: %d of %d rows in %d groups go on", digit, alive.count(), rows.count(), groups.count())
    discard(rows, groups)
    return alive


def settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, open), as tables: rows whose span is found twice, as (id, text_hash, at); and the representatives that have to be cut narrower, as (id, text_hash, at, settled).

    rows are those that the passes left. A settled row stands for a span that was found twice in wider
    bundles; it is compared with, not found again. Of each distinct span one row goes on, if its group has an unsettled one.
    """
    spans = rows.groupBy(*SPAN).agg(F.count("*").alias("n"), F.min(F.struct("id", "text_hash", "at", "settled")).alias("rep"))
    spans = scratch(spans.select(*SPAN, "n", F.col("rep.*")).withColumn("settled", F.col("settled") | (F.col("n") > 1)), "spans")
    found = scratch(rows.where("not settled").join(spans.where("n > 1").select(*SPAN), SPAN, "left_semi").select("id", "text_hash", "at"), "found")
    groups = scratch(spans.groupBy("core").agg(F.count_if(~F.col("settled")).alias("unsettled")).where("unsettled > 0").select("core"), "groups")
    several = scratch(spans.join(groups, "core", "left_semi").select("id", "text_hash", "at", "settled"), "open")
    if log.isEnabledFor(logging.INFO):
        log.info("settled: %d rows of %d spans found, %d spans of %d groups are cut narrower", found.count(), spans.where("n > 1").count(), several.count(), groups.count())
    discard(rows, spans, groups)
    return found, several


def passages(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The bundles of windows of `WORDS` words, as (id, text_hash, doc, at, core, span); doc numbers the rows of docs."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = [text.encode("utf-8", "surrogatepass") for text in pdf["text"]]
            for a, b in runs_of_chars([len(t) for t in texts], TOGETHER):
                text, at, core, span = word_bundles(texts[a:b])
                yield pd.DataFrame({c: pdf[c].to_numpy()[a:b][text] for c in ("id", "text_hash", "doc")} | {"at": at, "core": core, "span": span})

    text = F.col(text_column).cast("string")
    rows = docs.select(id_key(id_column).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).where(F.octet_length("text") >= 2 * WORDS - 1)
    return rows.select("id", "text_hash", F.monotonically_increasing_id().alias("doc"), "text").mapInPandas(batches, "id long, text_hash long, doc long, at long, core long, span long")


def shared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, open), as tables: bundles whose span two documents have, as (id, text_hash, at); and those whose windows have to be compared, as (id, text_hash, doc, at, core, settled), with one bundle of each settled span of their core."""
    two = F.min("doc") < F.max("doc")
    cores = scratch(rows.groupBy("core").agg(two.alias("two")).where("two").select("core"), "cores")
    alive = scratch(rows.join(cores, "core", "left_semi"), "alive")
    spans = alive.groupBy("core", "span").agg(two.alias("settled"), F.min(F.struct("id", "text_hash", "doc", "at")).alias("rep"))
    spans = scratch(spans.select("core", "span", "settled", "rep.*"), "spans")
    found = scratch(alive.join(spans.where("settled").select("core", "span"), ["core", "span"], "left_semi").select("id", "text_hash", "at"), "found")
    alone = alive.join(spans.where("not settled").select("core", "span"), ["core", "span"], "left_semi").withColumn("settled", F.lit(False))
    groups = scratch(spans.where("not settled").select("core").distinct(), "groups")
    both = alone.unionByName(spans.where("settled").join(groups, "core", "left_semi")).drop("span")
    several = scratch(both, "open")
    if log.isEnabledFor(logging.INFO):
        log.info("words: %d of %d bundles go on, %d found, windows of %d are compared", alive.count(), rows.count(), found.count(), several.count())
    discard(rows, cores, alive, spans, groups)
    return found, several


def shared_windows(texts: DataFrame, several: DataFrame) -> DataFrame:
    """The windows of unsettled bundles that another document has, as a table (id, text_hash, at)."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for key, text_hash, text, held in pdf.itertuples(index=False):
                words, _ = word_hashes(_expand(text))
                hashes = np.concatenate([string_hashes(sums_of(words[a : a + PART + WORDS - 1]), WORDS) for a in range(0, len(words) - WORDS + 1, PART)])
                doc, at, core, settled = (np.array([one[c] for one in held]) for c in ("doc", "at", "core", "settled"))
                first, n, _ = unpacked(at)
                window = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                of = {"doc": np.repeat(doc, n), "at": packed(window, 1, 0), "core": np.repeat(core, n), "window": hashes[window].view(np.int64), "settled": np.repeat(settled, n)}
                out.append(pd.DataFrame({"id": key, "text_hash": text_hash} | of))
            if out:
                yield pd.concat(out)

    by_text = several.groupBy("id", "text_hash").agg(F.collect_set(F.struct("doc", "at", "core", "settled")).alias("held"))
    rows = texts.join(by_text, ["id", "text_hash"]).select("id", "text_hash", "bytes", "held")
    windows = scratch(rows.mapInPandas(batches, "id long, text_hash long, doc long, at long, core long, window long, settled boolean"), "windows")
    both = windows.groupBy("core", "window").agg((F.bool_or("settled") | (F.min("doc") < F.max("doc"))).alias("shared"), F.bool_and("settled").alias("settled"))
    both = scratch(both.where("shared and not settled").select("core", "window"), "both")
    found = scratch(windows.where("not settled").join(both, ["core", "window"], "left_semi").select("id", "text_hash", "at"), "found")
    if log.isEnabledFor(logging.INFO):
        log.info("words: %d of %d windows found", found.count(), windows.count())
    discard(windows, both)
    return found


def _pack(text: str) -> bytes:
    import zstandard

    return zstandard.compress(text.encode("utf-8", "surrogatepass"), 3)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data)


def repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, n_shared_words, kept) of every row of docs; kept: the bytes that stay, null where all do.

    sha: the SHA-256 of the kept bytes, in hex. n_shared_words: words in passages of over 50 words that another row has too.
    """

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(_pack)

    alive = scratch(bundles(docs, id_column, text_column), "bundles")
    for digit in THROUGH:
        alive = sort_pass(alive, digit)
        alive = alive if digit == THROUGH[-1] else alive.drop(digit)
    found, reps = settle(alive)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(id_key(id_column).alias("id"), F.xxhash64(F.col(text_column).cast("string")).alias("text_hash"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"), pack(text).alias("bytes"))
    said, several = shared(scratch(passages(docs, id_column, text_column), "word_bundles"))
    touched = reduce(DataFrame.unionByName, [x.select("id", "text_hash") for x in (found, reps, said, several)]).distinct().withColumn("touched", F.lit(True))
    rows = rows.join(touched, ["id", "text_hash"], "left").select("id", "text_hash", "n_bytes", "sha", "touched", F.when(F.col("touched"), F.col("bytes")).alias("bytes"))
    rows = scratch(rows, "texts")
    texts = rows.where("touched")
    one_each = texts.dropDuplicates(["id", "text_hash"])
    all_found = [found]
    for width in NARROWER:
        before = reps
        more, reps = settle(sort_pass(scratch(ordered(one_each, before, width), "bundles"), "core"))
        discard(before)
        all_found.append(more)
    all_said = [said, shared_windows(one_each, several)]
    discard(several)
    ranges = reduce(DataFrame.unionByName, [x.withColumn("words", F.lit(words)) for words, frames in ((False, all_found), (True, all_said)) for x in frames])
    ranges = ranges.groupBy("id", "text_hash").agg(F.collect_set(F.when(~F.col("words"), F.col("at"))).alias("ats"), F.collect_set(F.when(F.col("words"), F.col("at"))).alias("word_ats"))
    cut = texts.join(ranges, ["id", "text_hash"], "left").select("id", "n_bytes", "sha", "bytes", "ats", "word_ats")
    cut = cut.mapInPandas(_removed, "id long, n_bytes long, n_removed long, n_spans long, sha string, n_shared_words long, kept binary")
    none = F.lit(0).cast("long")
    whole = rows.where("touched is null").select("id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), "sha", none.alias("n_shared_words"), F.lit(None).cast("binary").alias("kept"))
    return whole.unionByName(cut)


def _covered(ats: np.ndarray | None, depth: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) that the windows of depth at these places cover."""
    if ats is None or not len(ats):
        return []
    first, n, _ = unpacked(np.sort(np.asarray(ats, np.int64)))
    end = np.maximum.accumulate(first + n - 1 + depth)
    apart = np.flatnonzero(first[1:] > end[:-1])
    return list(zip(first[np.concatenate(([0], apart + 1))].tolist(), end[np.concatenate((apart, [len(end) - 1]))].tolist(), strict=True))


def _removed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        out = []
        for key, n_bytes, sha, data, ats, word_ats in pdf.itertuples(index=False):
            spans, n_shared = _covered(ats, DEPTH), sum(b - a for a, b in _covered(word_ats, WORDS))
            if not spans:
                out.append((key, n_bytes, 0, 0, sha, n_shared, None))
                continue
            raw, kept, at = _expand(data), [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            stays = b"".join([*kept, raw[at:]])
            out.append((key, n_bytes, n_bytes - len(stays), len(spans), hashlib.sha256(stays).hexdigest(), n_shared, stays))
        yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "sha", "n_shared_words", "kept"])


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated(table(spark, sf_dir, "documents"))
    return out.select(from_key("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"), "n_shared_words")
