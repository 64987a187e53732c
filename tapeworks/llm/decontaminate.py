"""Benchmark decontamination (operator 1): a generalised suffix automaton of the test items.

The normalised items (words of `WORD_BYTES`, A-Z lower-cased) go into one generalised suffix
automaton. Each document's words are streamed through it; the automaton's match length is that
of the longest suffix of the words so far which stands in an item. Where it reaches `window`
words, the last `window` words are an occurrence of a window of those items which contain them;
an item of fewer words, but at least one, is one window itself.

The automata are built in tasks, one for each block of about `BLOCK_CHARS` characters of items (an
item longer than `PART_WORDS` words comes in parts that overlap by a window less a word, so that a
block has that bound). They are written to a table, from which one at a time is broadcast; the
documents are read once for each block (every document against every item, in blocks), and the hits
of several blocks meet in an aggregation by document.

A null or empty text has no words, no hits and is not contaminated. Items whose text is null, empty
or without a word have no window. An item without an id hits like others, and its name is the
empty string (so all such items count as one in n_items). Rows of one item_id are one
item; repeated documents are each judged. Empty tables give no rows, or no hits. Columns of any name
and type are carried along by `decontaminate`, and not read.
A document is contaminated if it has a hit and `share` times its hit words reach its words.
"""

from __future__ import annotations

import pickle
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import boxed, discard, from_key, id_key, inside, scratch, table

WINDOW = 13
SHARE = 20
BLOCK_CHARS = 5_000_000
PART_WORDS = 20_000
#: Bytes as they count in words: digits, lower-case letters (A-Z become those) and all of non-ASCII; the rest separates words.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items of each window's state.

    Most states have one edge, so a state is a place in flat arrays of first edges, links and
    lengths; `more` has the further edges of those which branch.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.shortest = window
        self.names: list[str] = []
        numbers: dict[str, int] = {}
        coded = []
        for name, item in items:
            ids = array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item])
            if ids:
                coded.append((numbers.setdefault(name, len(numbers)), ids))
                self.shortest = min(self.shortest, len(ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.names = list(numbers)
        #: state: (words, items) of whole short items there
        self.short: dict[int, tuple[int, set[int]]] = {}
        states, owners = array("i"), array("i")
        for name, ids in coded:
            if len(ids) < window:
                state = 0
                for c in ids:
                    state = self._next(state, c)
                self.short.setdefault(state, (len(ids), set()))[1].add(name)
            else:
                for _, state, matched in self._walk(ids):
                    if matched >= window:
                        states.append(state)
                        owners.append(name)
        # items with a full window in a state, by state: owners[first[state] : first[state + 1]]
        pairs = np.unique(np.array(states, np.int64) << 32 | np.array(owners, np.int64))
        self.first = array("i", np.searchsorted(pairs >> 32, np.arange(len(self.link) + 1)).astype(np.int32).tobytes())
        self.owners = array("i", pairs.astype(np.int32).tobytes())
        #: the nearest state at or above, by suffix links, that is a short item
        self.nearest = array("i", [-1]) * len(self.link)
        for state in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist() if self.short else ():
            self.nearest[state] = state if state in self.short else self.nearest[self.link[state]] if state else -1

    def _next(self, state: int, c: int) -> int:
        """The state after c, or -1."""
        if self.word[state] == c:
            return self.to[state]
        return self.more[state].get(c, -1) if state in self.more else -1

    def _point(self, state: int, c: int, target: int) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.to[state] = c, target
        else:
            self.more.setdefault(state, {})[c] = target

    def _state(self, length: int, word: int = -1, to: int = -1, link: int = 0) -> int:
        self.word.append(word)
        self.to.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, c: int) -> int:
        link, length = self.link, self.length
        q = self._next(last, c)
        if q >= 0:
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = self._state(length[last] + 1)
        p = last
        while p != -1 and (q := self._next(p, c)) < 0:
            self._point(p, c, cur)
            p = link[p]
        if p != -1:
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = self._state(self.length[p] + 1, self.word[q], self.to[q], self.link[q])
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p != -1 and self._next(p, c) == q:
            self._point(p, c, new)
            p = self.link[p]
        return new

    def _walk(self, ids: Sequence[int]) -> Iterator[tuple[int, int, int]]:
        """(place after the word, state, match length) after each of ids; longer matches than a window are cut to its state."""
        word, to, more, link, length, window = self.word, self.to, self.more, self.link, self.length, self.window
        none: dict[int, int] = {}
        state = matched = 0
        for i, c in enumerate(ids, 1):
            # `_next`, without a call for each word
            while (q := to[state] if word[state] == c else more.get(state, none).get(c, -1)) < 0 and state:
                state = link[state]
                matched = length[state]
            if q >= 0:
                state = q
                matched += 1
            while matched > window and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            yield i, state, matched

    def hits(self, ids: Sequence[int]) -> Iterator[tuple[int, int, int]]:
        """(place after the last word, words, state) of each window's occurrence in ids; `items_of` has the items."""
        for i, state, matched in self._walk(ids):
            if matched >= self.window:
                yield i, self.window, state
            at = self.nearest[state]
            while at > 0:
                n = self.short[at][0]
                if n <= matched:
                    yield i, n, at
                at = self.nearest[self.link[at]]

    def items_of(self, words: int, state: int) -> Iterable[int]:
        """The numbers of the items that have a window of so many words in a state."""
        return self.owners[self.first[state] : self.first[state + 1]] if words == self.window else self.short[state][1]

    def match(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(merged hit ranges of words, items with a window in the text).

        Only runs of known words that are long enough for the shortest window are walked.
        """
        get = self.vocabulary.get
        ids = [get(w, -1) for w in text_words]
        ranges: list[tuple[int, int]] = []
        reached: set[tuple[int, int]] = set()
        n, i = len(ids), 0
        while i + self.shortest <= n:
            # the run around the word at which a window that starts at i would end
            j = i + self.shortest - 1
            while j >= i and ids[j] >= 0:
                j -= 1
            if j >= i:
                i = j + 1
                continue
            end = i + self.shortest
            while end < n and ids[end] >= 0:
                end += 1
            for at, size, state in self.hits(ids[i:end]):
                reached.add((size, state))
                a, b = i + at - size, i + at
                while ranges and ranges[-1][1] >= a:
                    a = min(a, ranges.pop()[0])
                ranges.append((a, b))
            i = end + 1
        items = {item for size, state in reached for item in self.items_of(size, state)}
        return ranges, {self.names[item] for item in items}


def item_parts(items: DataFrame, window: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(name, part, chars): each distinct item's words, joined by spaces, in parts that have all its windows."""

    def parts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(PART_WORDS - window + 1, 1)
        for pdf in it:
            out = []
            for name, text in pdf.itertuples(index=False):
                w = words(text)
                for i in range(0, max(len(w) - window + 1, 1) if w else 0, step):
                    out.append((name, b" ".join(w[i : i + step + window - 1])))
            yield pd.DataFrame({"name": [n for n, _ in out], "part": [x for _, x in out], "chars": [len(x) for _, x in out]})

    rows = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("name"), F.col(text_column).cast("string").alias("text")).distinct()
    return rows.mapInPandas(parts, "name string, part binary, chars long")


def automata(items: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(block, automaton): the pickled automata of all items, in blocks of about block_chars characters, as a written table."""

    def built(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = SuffixAutomaton([(n, p.split()) for n, p in zip(pdf["name"], pdf["part"], strict=True)], window)
        return pd.DataFrame({"block": [key[0]], "automaton": [pickle.dumps(made, protocol=5)]})

    parts = scratch(item_parts(items, window, id_column, text_column), "items")
    n = -(-int(parts.agg(F.sum("chars")).first()[0] or 0) // block_chars)
    blocks = parts.withColumn("block", F.pmod(F.xxhash64("name", "part"), F.lit(max(n, 1))))
    out = scratch(blocks.groupBy("block").applyInPandas(built, "block long, automaton binary"), "automata")
    discard(parts)
    return out


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, text_hash, n_words, ranges, items) of every row of docs; ranges [a, b) of hit words, merged; items sorted as strings.

    id has `NULL_ID` for null; with text_hash it names the row, or several equal rows.
    """
    rows = docs.select(id_key(id_column).alias("id"), F.xxhash64(F.col(text_column).cast("string")).alias("text_hash"), F.col(text_column).cast("string").alias("text"))
    built = automata(items, window, block_chars, item_id, item_text)
    blocks = [r["block"] for r in built.select("block").collect()]
    if len(blocks) < 2:
        return _matched(rows, _only(built, window))[0]
    return _met(rows, built, blocks)


def _only(built: DataFrame, window: int) -> bytes:
    """The automaton of a table that has one, or none."""
    row = built.first()
    discard(built)
    return row["automaton"] if row else pickle.dumps(SuffixAutomaton([], window))


def _met(rows: DataFrame, built: DataFrame, blocks: list[int]) -> DataFrame:
    """What the automata of several blocks find in rows, as in `matches`: one pass over rows for each."""
    each = []
    for block in blocks:
        found, shared = _matched(rows, built.where(F.col("block") == block).first()["automaton"])
        # equal rows have equal results: one of them, and how many there are
        each.append(scratch(found.groupBy("id", "text_hash").agg(F.count("*").cast("int").alias("copies"), F.first("n_words").alias("n_words"), F.first("ranges").alias("ranges"), F.first("items").alias("items")), "matches"))
        shared.destroy()
    discard(built)
    start = F.array().cast("array<struct<a:int,b:int>>")
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("ranges"))),
        start,
        lambda out, r: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["b"] >= r["a"]), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(out, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(out, F.lit(-1))["b"], r["b"]).alias("b"))))).otherwise(F.concat(out, F.array(r))),
    )
    one = reduce(DataFrame.unionByName, each).groupBy("id", "text_hash").agg(F.first("copies").alias("copies"), F.first("n_words").alias("n_words"), merged.alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return one.select("id", "text_hash", "n_words", "ranges", "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


#: The automaton that a Python worker used last, so that its next task need not load it again.
_LOADED: dict[str, SuffixAutomaton] = {}


def loaded(name: str, shared: Broadcast) -> SuffixAutomaton:
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = pickle.loads(shared.value)
    return _LOADED[name]


def _matched(rows: DataFrame, automaton: bytes) -> tuple[DataFrame, Broadcast]:
    shared, name = rows.sparkSession.sparkContext.broadcast(automaton), uuid.uuid4().hex
    range_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = loaded(name, shared)
        for batch in it:
            n, ranges, items = [], [], []
            for text in batch.column(2):
                w = words(text.as_py())
                r, found = a.match(w)
                n.append(len(w))
                ranges.append([{"a": x, "b": y} for x, y in r])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ranges, range_type), pa.array(items, pa.list_(pa.string()))], ["id", "text_hash", "n_words", "ranges", "items"])

    return rows.mapInArrow(batches, "id long, text_hash long, n_words long, ranges array<struct<a:int,b:int>>, items array<string>"), shared


def judged(found: DataFrame, share: int = SHARE) -> DataFrame:
    """Adds n_hit, n_items and contaminated to what `matches` found."""
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + (r["b"] - r["a"]))
    hit = found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")})
    return hit.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE, max_span: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, without contaminated ones (the coverage limit), and without the hit spans of max_span or more words in the others (the length limit).

    A removed span goes from the first byte of its first word to the last of its last. Text
    without such a span stays as it is, null included. With one block of items (`BLOCK_CHARS`)
    documents are matched and cut where they are read, and no row moves between tasks. With several
    blocks the hits of all are written as a table, which the documents are joined with.
    """
    built = automata(items, window, block_chars, item_id, item_text)
    blocks = [r["block"] for r in built.select("block").collect()]
    text = inside(text_column).cast("string")
    if len(blocks) < 2:
        rows = boxed(docs).withColumn("done", _judge_and_cut(docs.sparkSession, _only(built, window), share, max_span)(text))
        kept = rows.where("not done.contaminated")
        cut = F.coalesce("done.text", text)
    else:
        keys = {"id": id_key(inside(id_column)), "text_hash": F.xxhash64(text)}
        found = judged(_met(boxed(docs).select(*[c.alias(k) for k, c in keys.items()], text.alias("text")), built, blocks), share).where("n_hit > 0")
        hit = found.groupBy("id", "text_hash").agg(F.first("ranges").alias("ranges"), F.first("contaminated").alias("contaminated"))
        hit = scratch(hit, "hits")  # a table, so that the join on an id of many copies can be split
        kept = boxed(docs).withColumns(keys).join(hit, list(keys), "left").where(~F.coalesce("contaminated", F.lit(False)))
        cut = _without(text, F.filter("ranges", lambda r: r["b"] - r["a"] >= max_span))
    return kept.select(*[(cut if c == text_column else inside(c)).alias(c) for c in docs.columns])


def without_words(text: str, ranges: Iterable[tuple[int, int]]) -> str:
    """text without the ranges [a, b) of its words."""
    raw = text.encode("utf-8", "replace")
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(WORD_BYTES))]
    kept, at = [], 0
    for a, b in ranges:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "replace")


def _judge_and_cut(spark: SparkSession, automaton: bytes, share: int, max_span: int):
    """A function of a text: is it contaminated, and the text without its long hit spans (null where it has none)."""
    shared, name = spark.sparkContext.broadcast(automaton), uuid.uuid4().hex

    @F.pandas_udf("contaminated boolean, text string")
    def done(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = loaded(name, shared)
        for texts in it:
            contaminated, cut = [], []
            for t in texts:
                w = words(t)
                ranges = a.match(w)[0]
                n_hit = sum(y - x for x, y in ranges)
                spans = [(x, y) for x, y in ranges if y - x >= max_span]
                contaminated.append(n_hit > 0 and share * n_hit >= len(w))
                cut.append(without_words(t, spans) if spans and not contaminated[-1] else None)
            yield pd.DataFrame({"contaminated": pd.Series(contaminated, dtype=bool), "text": pd.Series(cut, dtype=object)})

    # the plan must not copy it into the filter, where it would run once more
    return done.asNondeterministic()


def _without(text, spans):
    @F.pandas_udf("string")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = [t if t is None or found is None or not len(found) else without_words(t, [(r["a"], r["b"]) for r in found]) for t, found in zip(texts, ranges, strict=True)]
        return pd.Series(out, dtype=object)

    return cut(text, spans)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(from_key("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
