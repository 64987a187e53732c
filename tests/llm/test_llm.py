"""The operators of the training-data pipeline against brute force, on small tables with the awkward cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import tapeworks
from tapeworks.llm import bpe, chat, classlm, common, decontaminate, langid, linededup, minhash, passages, pfor, quality, shingles

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, id string, h long, n int, lines string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(f"{WORDS[i * 7 % 24]}{i * i % 97}" for i in range(400))
TEXTS = [
    None, "", " ", "\n\n", "one", "Ünïcode wörds, and more. 日本語", LONG, LONG, LONG.replace("alpha0", "changed", 1), "x" + LONG[50:1500], "a" * 3000, "a b " * 400,
    "Boiler line here.\nown text number one is long enough to keep its words\n" + LONG[:300], "boiler  LINE here.\nsecond text with other words entirely\n" + LONG[300:900], "tabs\tand  doubles . , ,x\r\nend",
    "<|endoftext|> </s>[INST] x", LONG[:700] + "\n" + LONG[:700],
]


@pytest.fixture(scope="module")
def docs(spark):
    tapeworks.distribute(spark)
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", "clash", 1, 2, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, LONG, None, None, None, None, None, None)]  # a repeated row, a null id
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def source(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def op_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize(("block_chars", "part_words"), [(10**6, 20_000), (300, 20_000), (300, 30)])
def test_decontamination(spark, docs, empty, block_chars, part_words, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_WORDS", part_words)
    items = [("1", LONG[100:400]), ("10", "one"), ("2", "Wörds and, MORE"), ("3", ""), ("4", None), ("5", LONG[100:400]), ("6", "alpha beta"), (None, LONG[900:1300]), (None, "tabs and"), ("2", LONG[1500:1700]), ("7", LONG)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.judged(decontaminate.matches(docs, bench, block_chars=block_chars))
    want = []
    for d, t in source(docs):
        w, hit, found = op_words(t), set(), set()
        for name, item in items:
            x = op_words(item)
            size = min(13, len(x))
            for a in range(len(x) - size + 1 if x else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == x[a : a + size]:
                        hit |= set(range(p, p + size))
                        found.add(name or "")
        want.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    rows = got.withColumn("id", decontaminate.from_key("id"))
    assert pairs(rows, "id", "n_words", "n_hit", "items", "contaminated") == sorted(want, key=repr)
    kept = decontaminate.decontaminate(docs, bench, block_chars=block_chars)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not w[-1] for w in want)
    assert decontaminate.matches(empty, bench).isEmpty()
    assert decontaminate.judged(decontaminate.matches(docs, bench.limit(0))).where("contaminated").isEmpty()


def test_decontamination_carries_columns_of_any_name(spark, docs):
    df = docs.withColumnsRenamed({"h": "ranges", "n": "contaminated", "id": "__id", "lines": "text_hash"})
    bench = spark.createDataFrame([("1", LONG[100:400])], "item_id string, text string")
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and {r["__id"] for r in kept.collect()} <= {"clash", None}
    long = spark.createDataFrame([(1, "w " * 300_000 + LONG)], "doc_id long, text string")
    assert decontaminate.judged(decontaminate.matches(long, bench)).first().n_hit > 0


def test_spans_are_cut(spark):
    d = spark.createDataFrame([(1, "w " * 500 + "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12, M13. tail")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12 m13")], "item_id long, text string")
    assert decontaminate.decontaminate(d, bench).first().text == "w " * 500 + ". tail"


def test_documents_are_matched_and_cut_where_they_are_read(spark, docs):
    bench = spark.createDataFrame([("1", LONG[100:400])], "item_id string, text string")
    kept = decontaminate.decontaminate(docs, bench)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
    # several blocks join the hits instead; the rows are the same
    assert pairs(kept, *docs.columns) == pairs(decontaminate.decontaminate(docs, bench, block_chars=50), *docs.columns)


@pytest.mark.parametrize("window", [2, 3, 6])
def test_automaton_against_brute_force(window):
    rng = random.Random(window)

    def some(most):
        return [str(rng.randrange(4)).encode() for _ in range(rng.randrange(most))]

    for _ in range(200):
        items = [(str(rng.randrange(5)), some(30)) for _ in range(rng.randrange(6))]
        text, hit, found = some(60), set(), set()
        for name, item in items:
            size = min(window, len(item))
            for a in range(len(item) - size + 1 if item else 0):
                for p in range(len(text) - size + 1):
                    if text[p : p + size] == item[a : a + size]:
                        hit |= set(range(p, p + size))
                        found.add(name)
        ranges, names = decontaminate.SuffixAutomaton(items, window).match(text)
        assert ([i for a, b in ranges for i in range(a, b)], names) == (sorted(hit), found)


def test_cells_of_a_giant_dictionary_need_64_bits():
    most = 2**32 // (2 * classlm.CLASSES)
    assert classlm.cell_type(most) is np.uint32 and classlm.cell_type(most + 1) is np.uint64


def test_chat_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "<</SYS>> \\\\", "", None, "[ROLE x]", "plain", "[/INST", " lead", "[/ROLE]"]
    rows = [(c, t, r, x) for c, (r, x) in enumerate(itertools.product(["user", "assistant", "system", "tool ]", "", None], hostile)) for t in (0, 1)]
    df = spark.createDataFrame([*rows, (None, None, "user", "u")], "conv_id long, turn long, role string, text string")
    got = {r.id: r for r in chat.conversations(chat.format_turns(df)).collect()}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        body = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (2, hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r.id: r.formatted for r in chat.texts(chat.format_turns(df)).collect()}
    assert all(len(whole[c]) == got[c].formatted_chars for c in {r[0] for r in rows})
    assert chat.conversations(chat.format_turns(df.limit(0))).isEmpty()


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 50, 1 << 16])
def test_chat_is_read_from_pieces_cut_anywhere(piece, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", piece)
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "\\ [/INST]"), ("system", ""), ("assistant", ""), ("tool ]", "x" * 300 + "[/ROLE]"), ("user", "a\\"), ("assistant", "<s>")]
    formatted = chat.BEGIN + "".join(chat.format_turn(*t) for t in turns)
    reader = chat.Reader()
    got = [t for i in range(0, len(formatted), piece) for t in reader.feed(formatted[i : i + piece])] + list(reader.end())
    assert got == turns
    digests = chat.Digests()
    for t in turns:
        digests.write(chat.format_turn(*t))
    body = "".join(f"{r}\n{x}\n" for r, x in turns)
    assert digests.ended()[:2] == (len(turns), hashlib.sha256(body.encode()).hexdigest())
    for wrong in (formatted[:-1], formatted + "x", formatted[1:]):
        reader = chat.Reader()
        with pytest.raises(ValueError):
            [*reader.feed(wrong), *reader.end()]


def test_a_very_long_turn(spark):
    text = "[INST] " * 100_000
    row = chat.conversations(chat.format_turns(spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", "u")], "conv_id long, turn long, role string, text string"))).first()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


def test_passages(docs, empty):
    rows = source(docs)
    counts = collections.Counter(b[i : i + 400] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 399))
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if counts[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = passages.repeated(docs).withColumn("id", passages.from_key("id"))
    assert pairs(got, "id", "n_bytes", "n_removed", "n_spans", "sha") == sorted(want, key=repr)
    assert passages.repeated(empty).isEmpty()


def test_spans_of_equal_cores_are_told_apart(spark):
    """Texts that share the anchor of many windows, and most bytes around it, but differ at either end."""
    rng = np.random.default_rng(9)
    base = "".join(map(chr, rng.integers(97, 123, 900)))
    texts = [base[:a] + "#" + base[a + 1 :] for a in (0, 100, 250, 399, 400, 500, 650, 899)] + [base[k : k + 420] for k in range(0, 480, 37)] + ["~" + base[1:399] + "~", base]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = {}
    for d, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if counts[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        want[d] = (sum(gone), len(re.findall(b"\1+", bytes(gone))))
    assert {r.id: (r.n_removed, r.n_spans) for r in passages.repeated(df).collect()} == want


def shared_words(texts):
    """Of each text the words in runs of 51 that another text has too, by brute force."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    owners = collections.defaultdict(set)
    for d, w in enumerate(words):
        for i in range(len(w) - 50):
            owners[tuple(w[i : i + 51])].add(d)
    out = []
    for w in words:
        said = bytearray(len(w))
        for i in range(len(w) - 50):
            if len(owners[tuple(w[i : i + 51])]) > 1:
                said[i : i + 51] = b"\1" * 51
        out.append(sum(said))
    return out


def test_passages_of_over_50_words_that_documents_share(docs):
    rows = sorted(source(docs), key=repr)
    got = pairs(passages.repeated(docs).withColumn("id", passages.from_key("id")), "id", "n_shared_words")
    assert got == sorted(((d, n) for (d, _), n in zip(rows, shared_words([t for _, t in rows]), strict=True)), key=repr)


def test_shared_passages_shorter_than_400_bytes(spark):
    rng = np.random.default_rng(12)

    def prose(n):
        return ["".join(map(chr, rng.integers(97, 123, k))) for k in rng.integers(2, 6, n)]

    passage, long, near = prose(55), prose(400), prose(300)
    assert len(" ".join(passage)) < 400
    words = [[*prose(40), *passage, *prose(70)], [*passage, *prose(90)], [*prose(200), *passage]]
    words += [[*prose(30), *passage[:50], *prose(30)], passage[4:], passage[5:]]  # 50 words are not over 50
    words += [[*(own := prose(60)), "apart", *own]]  # no other document has them
    words += [[*long[:a], "#", *long[a + 1 :]] for a in (0, 50, 51, 130, 200, 399)] + [long[k : k + 60] for k in range(0, 340, 23)] + [[*near, *prose(9), *near[7:]], near, near]
    words += [["la"] * 700, ["la"] * 51, ["la"] * 50]
    texts = [("\n" if i % 3 else "\t ").join(w) for i, w in enumerate(words)] + ["\xa0".join(passage), "", None, " \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_removed, r.n_shared_words) for r in passages.repeated(df).collect()}
    want = shared_words(texts)
    assert {d: n for d, (_, n) in got.items()} == dict(enumerate(want))
    assert [got[d] for d in range(7)] == [(0, 55), (0, 55), (0, 55), (0, 0), (0, 51), (0, 0), (0, 0)]
    twice = spark.createDataFrame([(None, texts[0]), (None, texts[0]), (1, texts[6])], "doc_id long, text string")
    assert sorted(r.n_shared_words for r in passages.repeated(twice).collect()) == [0, 165, 165]


@pytest.mark.parametrize("part", [1, 2, 7, 64, 1 << 20])
def test_word_hashes_in_parts(part, monkeypatch):
    rng = np.random.default_rng(13)
    words = ["".join(map(chr, rng.integers(97, 100, k))) for k in rng.integers(1, 12, 300)]
    plain, _ = passages.word_hashes(" ".join(words).encode())
    assert len(plain) == 300 and len(set(plain.tolist())) == len(set(words))

    def windows(texts):
        text, at = (x.tolist() for x in passages.word_bundles(texts)[:2])
        return sorted((t, p, first + offset) for t, (first, n, offset) in zip(text, map(passages.unpacked, at), strict=True) for p in range(first, first + n))

    texts = [" ".join(w).encode() for w in (words[:50], words, [], words[:51], words[100:250], [])]
    whole = [(t, p, m) for t, x in enumerate(texts) for _, p, m in windows([x])]
    assert [x[:2] for x in whole] == [(t, p) for t, n in enumerate((0, 250, 0, 1, 100, 0)) for p in range(n)]
    monkeypatch.setattr(passages, "PART", part)
    raw = (" " + "\r\n".join(words) + "\x0b").encode()
    for text in (raw, raw[1:], raw[:-1], raw[1:-1]):
        hashes, starts = passages.word_hashes(text)
        assert (hashes == plain).all() and [text[a : a + len(w)].decode() for a, w in zip(starts, words, strict=True)] == words
    assert [passages.word_hashes(x)[0].tolist() for x in (b"", b"\t")] == [[], []]
    assert windows(texts) == whole


def test_passages_in_parts(monkeypatch):
    raw = np.random.default_rng(1).integers(97, 100, 5000, dtype=np.uint8).tobytes()
    whole = [x.tolist() for x in passages.anchors(passages.prefix_sums(raw))]
    monkeypatch.setattr(passages, "PART", 700)
    windows = {}
    for start, part in passages.parts(raw):
        for a, b, m in zip(*[x.tolist() for x in passages.anchors(passages.prefix_sums(part))], strict=True):
            windows |= {start + p: start + m for p in range(a, b + 1)}
    assert windows == {p: m for a, b, m in zip(*whole, strict=True) for p in range(a, b + 1)}


def test_bundles_hold_each_suffix_once_and_digits_are_its_bytes():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 100, 3000, dtype=np.uint8).tobytes()
    raw += b"#" * 50 + raw[100:1500]  # the same suffixes again, far from where they were
    first, last, anchor, digits = passages.suffix_digits(raw)
    starts = sorted(p for a, b in zip(first, last, strict=True) for p in range(a, b + 1))
    assert starts == list(range(len(raw) - 399)) and (last - first < passages.WIDTH).all() and ((0 <= anchor - last) & (anchor - first <= 300)).all()
    assert digits.shape == (len(first), len(passages.DIGITS))
    for column, depth in zip(digits.T, passages.DIGITS, strict=True):
        of = {p: (k, a - p) for x, y, a, k in zip(first, last, anchor, column, strict=True) for p in range(x, y + 1)}
        assert all(of[p] == of[p + 2950] for p in range(100, 1101))  # equal windows, equal digits
        seen = {}
        for x, y, a, k in zip(first.tolist(), last.tolist(), anchor.tolist(), column.tolist(), strict=True):
            near = (a - y) // passages.WIDTH * passages.WIDTH
            shared = raw[a - near : a - near - passages.WIDTH + 1 + depth]
            assert seen.setdefault(k, (near, shared)) == (near, shared)


def test_line_dedup(spark, docs, empty):
    rows = [(i, f"{'Common LINE' if i % 2 else 'common  line '}\nown words of document {i} are here\n\nmore {i}", f"s{i % 12}") for i in range(40)]
    rows += [(100 + i, "copied text\nstands everywhere", f"s{i}") for i in range(12)] + [(200, None, "s1"), (201, "", None), (202, "common line", "s1"), (203, "common line\n\t COMMON line\nx", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in linededup.marked(df).select("row.doc_id", "cut", "n_lines", "n_removed").collect()}
    assert all(got[i].cut == f"own words of document {i} are here\n\nmore {i}" and got[i].n_removed == 1 and got[i].n_lines == 3 for i in range(40))
    assert all(got[100 + i].cut == "copied text\nstands everywhere" for i in range(12))  # one text, however many sites have it
    assert (got[200].cut, got[201].cut, got[202].cut, got[203].cut) == (None, "", "", "x")
    assert linededup.dedup(docs).columns == docs.columns and linededup.dedup(docs).count() == docs.count()
    assert linededup.dedup(empty).isEmpty()


def test_line_operators_carry_columns_of_any_name(spark):
    names = {"doc_id": "hash", "h": "gone", "n": "length", "lines": "cut", "lang": "row", "id": "n_words"}
    rows = [(i, f"menu\n{' '.join(f'w{i}x{k}' for k in range(30))}", "en", f"s{i}", "v", 5, 6, "w") for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed(names)
    for out, cut in ((linededup.dedup(df), True), (quality.clean(df), False)):
        assert out.columns == df.columns
        assert sorted(map(tuple, out.drop("text").collect())) == sorted(map(tuple, df.drop("text").collect()))
        assert all(r.text.startswith("menu") != cut for r in out.collect())


def test_texts_of_very_many_lines(spark):
    """The work for a text grows with its lines, not with their square; numbers of lines are right at every place."""
    lines = [f"line {i % 70_000}" if i % 3 else "" for i in range(200_000)]
    rows = [(i, "\n".join([*lines, f"own {i}"]), f"s{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    out = linededup.marked(df).select("row.doc_id", "cut", "n_removed").collect()
    assert all(r.cut == "\n" * sum(not x for x in lines) + f"own {r.doc_id}" and r.n_removed == sum(map(bool, lines)) for r in out)
    q = quality.judged(df.withColumn("source", F.lit("h")), carry=["doc_id"], min_docs=5).select("row.doc_id", "n_dup_lines", "kept").collect()
    assert all(r.n_dup_lines == sum(map(bool, lines)) - len({x for x in lines if x}) and not r.kept for r in q)


def test_hyperloglog_sketches_merge(spark):
    df = spark.createDataFrame([(i, f"same line\nown {i}", f"s{i}") for i in range(30)], "doc_id long, text string, source string")
    halves = [linededup.spread(linededup.line_rows(df.where(F.col("doc_id") % 2 == k))) for k in (0, 1)]
    merged = linededup.merge(halves[0].unionByName(halves[1])).where(F.col("h") == F.xxhash64(F.lit("same line")))
    assert merged.select(F.hll_sketch_estimate("sites")).first()[0] == 30


def test_quality_base(docs, empty):
    want = []
    for d, t in source(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        ls = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    got = quality.judged(docs, carry=["doc_id"]).select("row.doc_id", "*")
    assert pairs(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert quality.judged(empty).isEmpty() and quality.clean(empty).columns == empty.columns


def test_boilerplate_of_a_host(spark):
    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(30)]
    rows = [(i, "menu line of the host\n" + own[i], "h") for i in range(30)] + [(50, "menu line of the host\n" * 3 + " ".join(f"z{k}" for k in range(19)), "h"), (51, own[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert kept == {i: own[i] for i in range(30)} | {51: own[0]}


def test_limits_do_not_grow_with_the_host(spark):
    """On a host of thousands of texts, a line in three of a hundred is boilerplate; one in a thousand documents is it on any host."""
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x"), k.cast("string"))), " ")
    rare = F.when(F.col("id") % 33 == 0, "a line in three of a hundred\n").when(F.col("id") % 1000 == 1, "seldom\n").otherwise("")
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(rare, own).alias("text"), F.lit("h").alias("source"))
    kept = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert len(kept) == 4000 and not any(t.startswith("a line") for t in kept.values()) and sum(t.startswith("seldom") for t in kept.values()) == 4
    often = {r.doc_id: r.text for r in quality.clean(df, line_percent=50, max_docs=100).collect()}
    assert not any(t.startswith("a line") for t in often.values())


def test_round_trip_is_encode_and_decode_in_one_worker(docs):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    two = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    one = bpe.round_trip(docs, path, pattern)
    row = lambda r: (str(r.id), r.n_tokens, bytes(r.ids), bytes(r.decoded))
    assert one.schema == two.schema and sorted(map(row, one.collect())) == sorted(map(row, two.collect()))
    plan = bpe.digests(docs, keep_ids=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_class_model_leaves_no_shuffle_files_of_its_tables(spark, docs, monkeypatch):
    def shuffled():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}

    def watched(df, what, **how):
        before, out = shuffled(), scratch(df, what, **how)
        for _ in range(100):  # Spark removes them soon after the write has ended
            if not (new := shuffled() - before):
                break
            time.sleep(0.1)
        left[what] = len(new)
        return out

    left, scratch, setting = {}, classlm.scratch, spark.conf.get(common.SHUFFLE_CLEANUP, None)
    monkeypatch.setattr(classlm, "scratch", watched)
    known, _ = classlm.train(scratch(classlm.blocks(docs, classlm.fold("doc_id", 7) == 2), "blocks"))
    assert left == {"counts": 0, "classes": 0, "known": 0} and known.count() > 0
    assert spark.conf.get(common.SHUFFLE_CLEANUP, None) == setting


def test_class_model(docs, empty):
    """Counts and both scores against a computation from the texts, given the words' classes."""
    coded = classlm.blocks(docs, classlm.fold("doc_id", 7) == 2).persist()
    known, model = classlm.train(coded)
    got = classlm.scores(coded, known, model).withColumn("id", classlm.from_key("id")).collect()
    by_tokens = {(bytes(r.tokens), tuple(r.ids)): r.hashes for r in coded.collect()}
    spark = docs.sparkSession
    token = {}
    c = collections.Counter()
    for d, t in source(docs):
        token[(d, t)] = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            c.update(token[(d, t)])
    n, v = sum(c.values()), len(c)
    hashes = {r.h: r.w for r in spark.createDataFrame([(w,) for x in token.values() for w in x if w], "w string").distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    cls = {hashes[h]: k for row in known.collect() for h, k, m in zip(by_tokens[bytes(row.tokens), tuple(row.ids)], row.c[1:], np.frombuffer(row.n, "<i8")[1:], strict=True) if m} | {None: classlm.CLASSES - 1}
    assert set(cls) == set(c)
    # the model from its definition
    bigrams, n_class, once = np.zeros((classlm.CLASSES,) * 2), np.zeros(classlm.CLASSES), np.zeros(classlm.CLASSES)
    for w, k in c.items():
        n_class[cls[w]] += k
        once[cls[w]] += k == 1 and w is not None
    for d, t in source(docs):
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            for a, b in itertools.pairwise([None, *token[(d, t)]]):
                bigrams[cls[a], cls[b]] += 1
    unseen = np.where(n_class > 0, (once + 0.5) / (n_class + 1), 1.0)
    unseen[-1] = 0

    def p(word, before):
        row = (bigrams[cls[before]] if before in c else bigrams.sum(axis=0)) + 0.1
        row = row / row.sum()
        by_class = row[cls[word]] * (1 - unseen[cls[word]]) * c[word] / n_class[cls[word]] if word in c else row @ unseen
        return 0.9 * by_class + 0.1 * (c[word] + 1) / (n + v + 1)

    for before in (None, "alpha0", "never seen"):
        assert abs(sum(p(w, before) for w in [*c, "never seen"]) - 1) < 1e-9
    want = [(repr(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6), round(sum(math.log10(p(b, a)) for a, b in itertools.pairwise([None, *w])), 6)) for d, t in source(docs) for w in [token[(d, t)]]]
    assert sorted((repr(r.id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)
    none = classlm.blocks(empty, F.lit(False))
    assert classlm.scores(none, *classlm.train(none)).isEmpty()
    untrained = classlm.blocks(docs, F.lit(True)).persist()
    assert {r.score for r in classlm.scores(untrained, *classlm.train(untrained)).collect()} == {0.0}


@pytest.mark.parametrize("tokens", [1, 7, 2_000_000])
def test_blocks_hold_whole_documents(spark, docs, tokens, monkeypatch):
    monkeypatch.setattr(classlm, "BLOCK_TOKENS", tokens)
    text = {}
    for d, t in source(docs):
        text.setdefault(d, []).append(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    word = {r.h: r.w for r in spark.createDataFrame([(w,) for x in text.values() for y in x for w in y], "w string").distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    got = {}
    for r in classlm.blocks(docs.coalesce(1), F.lit(False)).collect():
        seq = np.frombuffer(r.tokens, "<u4")
        assert r.train == np.bincount(seq, minlength=len(r.hashes) + 1).tolist()
        for d, n in zip(r.ids, r.lengths, strict=True):
            assert seq[n - 1] == 0
            got.setdefault(None if d == classlm.id_key and 0 else (d if d > -(2**62) else None), []).append([word[r.hashes[k - 1]] for k in seq[: n - 1]])
            seq = seq[n:]
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in text.items()}


def test_neighbour_counts_over_one_record(spark):
    tapeworks.distribute(spark)
    df = spark.createDataFrame([(1, "a b " * 1000 + "c")], "doc_id long, text string")
    coded = classlm.blocks(df, F.lit(False)).persist()
    known, _ = classlm.train(coded, sweeps=2)
    (row,) = known.collect()
    word = {r.h: r.w for r in spark.createDataFrame([("a",), ("b",), ("c",)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    cls = {word[h]: c for h, c in zip(row.hashes or coded.first().hashes, row.c[1:], strict=True)} | {None: classlm.CLASSES - 1}
    full = known.withColumn("hashes", F.array(*[F.lit(h) for h in coded.first().hashes]))
    seen = {}
    for r in classlm.neighbours(full).collect():
        x = np.frombuffer(r.data, classlm.NEIGHBOUR)
        seen[word[r.h]] = np.bincount(x["k"], x["n"], 2 * classlm.CLASSES)
    want = {w: np.zeros(2 * classlm.CLASSES) for w in "abc"}
    tokens = [None, *("a b " * 1000 + "c").split(), None]
    for before, after in itertools.pairwise(tokens):
        if before:
            want[before][cls[after]] += 1
        if after:
            want[after][classlm.CLASSES + cls[before]] += 1
    assert all(np.array_equal(seen[w], want[w]) for w in "abc")


def test_exchange_separates_and_never_loses():
    rng = np.random.default_rng(0)
    n = np.zeros((40, 40))
    for a, b in zip(s := rng.integers(0, 20, 4000), s[1:], strict=False):
        n[a, (b % 10) + (10 if a < 10 else 0)] += 1
    cls = classlm.exchange(n, classes=3)
    assert len({*cls[:10]}) == 1 and len({*cls[10:20]}) == 1 and cls[0] != cls[10]

    def reached(c):
        one = np.eye(3)[c]
        return classlm.likelihood(one.T @ n @ one)

    # no single move of a unit gains: the gains that the exchange computes are those of the likelihood
    for u in range(39):
        for k in range(2):
            other = cls.copy()
            other[u] = k
            assert reached(other) <= reached(cls) + 1e-6


@pytest.mark.parametrize("sweeps", [1, 3])
def test_all_words_get_the_class_of_their_contexts(spark, sweeps):
    tapeworks.distribute(spark)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"the n{rng.integers(3000)} does v{rng.integers(3000)}" for _ in range(60))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    coded = classlm.blocks(df, F.lit(False)).persist()
    known, model = classlm.train(coded, sweeps=sweeps)
    assert 2 <= len(model["likelihoods"]) <= 1 + sweeps and model["likelihoods"][1] > model["likelihoods"][0]
    hashes = {(bytes(r.tokens), tuple(r.ids)): r.hashes for r in coded.collect()}
    word = {r.h: r.w for r in df.select(F.explode(F.split("text", " ")).alias("w")).distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    kinds = collections.defaultdict(collections.Counter)
    for k in known.collect():
        for h, c in zip(hashes[bytes(k.tokens), tuple(k.ids)], k.c[1:], strict=True):
            kinds[c][word[h][0]] += 1
    n = sum(x.total() for x in kinds.values())
    assert n > 5000 and sum(max(x.values()) for x in kinds.values()) > 0.98 * n  # nouns and verbs apart


def naive_similarity(a, b):
    """The greater of the Jaccard similarity of two lists of shingles as sets and of their probability Jaccard, by the definition."""
    if not a or not b:
        return 0.0
    p, q = ({k: n / len(x) for k, n in collections.Counter(x).items()} for x in (a, b))
    jp = sum(1 / sum(max(p.get(y, 0) / p[k], q.get(y, 0) / q[k]) for y in p.keys() | q.keys()) for k in p.keys() & q.keys())
    return max(jp, len(p.keys() & q.keys()) / len(p.keys() | q.keys()))


def shingle_list(text):
    w = (text or "").lower().split()
    return [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_near_duplicates(docs, empty):
    rows = source(docs)
    sets = {d: shingle_list(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if naive_similarity(sets[a], sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)), key=lambda v: (v is not None, v or 0))
            root[y] = x
    got = minhash.near_duplicates(docs).select(minhash.from_key("id").alias("id"), minhash.from_key("class_id").alias("c"))
    assert pairs(got, "id", "c") == sorted(((d, find(d)) for d, _ in rows), key=repr)
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(find(d) for d in {find(d) for d in sets})
    assert minhash.near_duplicates(empty).isEmpty()


def test_texts_that_share_an_id_are_all_deduplicated(spark):
    tapeworks.distribute(spark)

    def text(k, last=""):
        return " ".join(f"w{k}x{i}" for i in range(60)) + last

    rows = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(4, " more")), (9, text(2)), (9, text(5)), (None, text(5)), (None, text(5, " more")), (3, text(3, " more")), (None, None), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in minhash.dedup(df).collect()]
    group = {t: t and " ".join(t.split()[:60]) for _, t in rows}
    assert collections.Counter(group[t] for _, t in kept) == collections.Counter([text(k) for k in range(1, 6)] + [None, ""])
    assert {group[t]: d for d, t in kept if group[t]} == {text(1): None, text(2): None, text(3): 3, text(4): 7, text(5): None}
    got = collections.Counter((r.a, r.b) for r in minhash.near_duplicates(df).select(minhash.from_key("id").alias("a"), minhash.from_key("class_id").alias("b")).collect())
    assert got == collections.Counter([(None, None)] * 6 + [(7, 3), (7, 7), (8, 7), (9, None), (9, None), (3, 3)])


def test_probability_jaccard():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = x[:250], x[50:]
    wa, wb = rng.integers(1, 5, 250), rng.integers(1, 5, 250)
    w = minhash.registers(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([250, 250]), 4000)
    p, q = dict(zip(a.tolist(), wa / wa.sum(), strict=True)), dict(zip(b.tolist(), wb / wb.sum(), strict=True))
    exact = sum(1 / sum(max(p.get(y, 0) / p[k], q.get(y, 0) / q[k]) for y in p.keys() | q.keys()) for k in p.keys() & q.keys())
    assert abs((w[0] == w[1]).mean() - exact) < 0.03


def test_similarity_of_weighted_shingles():
    rng = np.random.default_rng(5)
    for _ in range(60):
        x, y = ([f"w{v}" for v in rng.choice(40, rng.integers(1, 60))] for _ in range(2))
        y = x[: rng.integers(0, len(x) + 1)] + y[: rng.integers(0, 9)] or y
        codes = {w: i for i, w in enumerate(sorted({*x, *y}))}
        (a, m), (b, n) = (np.unique(np.array([codes[w] for w in v], np.uint64), return_counts=True) for v in (x, y))
        p, q = m / m.sum(), n / n.sum()
        want = sum(1 / sum(max(dict(zip(a, p, strict=True)).get(k, 0) / p[i], dict(zip(b, q, strict=True)).get(k, 0) / q[j]) for k in {*a, *b}) for i, u in enumerate(a) for j, v in enumerate(b) if u == v)
        assert abs(minhash.probability_jaccard(a, p, b, q) - want) < 1e-9
        blobs = [z for v, c in ((a, m), (b, n)) for z in (v.tobytes(), c.astype("<u4").tobytes() if (c > 1).any() else None)]
        assert minhash.similar(*blobs, 0.8) == (naive_similarity(x, y) >= 0.8 - 1e-12)


def test_recall_with_skewed_weights(spark):
    """All links of brute force: near sets whose counts differ much, near counts whose sets differ, and edits."""
    tapeworks.distribute(spark)
    rng = np.random.default_rng(7)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(300)]
        texts += [" ".join(base[:10] * r + base) for r in (0, 1, 5, 20, 60, 200)]
        texts += [" ".join([*base[:200], *(base[200:210] * 80), *(f"t{g}x{k}y{i}" for i in range(60))]) for k in range(2)]
        for k in (1, 4, 9, 14):
            edited = list(base)
            for i in rng.choice(300, k, replace=False):
                edited[i] = f"e{rng.integers(10**6)}"
            texts.append(" ".join(edited))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = dict(pairs(minhash.near_duplicates(df), "id", "class_id"))
    size, links = len(texts) // 12, 0
    for g in range(12):
        own = {i: shingle_list(texts[i]) for i in range(g * size, (g + 1) * size)}
        for a, b in itertools.combinations(own, 2):
            if naive_similarity(own[a], own[b]) >= 0.8:
                links += 1
                assert got[a] == got[b], (a, b)
    assert links > 200 and {got[i] // size for i in got} == set(range(12)) and all(got[i] // size == i // size for i in got)


@pytest.mark.parametrize("block", [256, 3])
def test_only_texts_of_different_components_meet(spark, monkeypatch, block):
    """Of all pairs of a group, each one of different labels that is similar is joined, over blocks of any size."""
    tapeworks.distribute(spark)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(25):
        words = list(base)
        for i in rng.choice(120, rng.integers(1, 8), replace=False):
            words[i] = f"e{rng.integers(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    ids = docs.select(F.struct(*[c.alias(n) for n, c in minhash.row_key(F.col("k"), F.col("text")).items()]).alias("id"), "k")
    label = F.when(F.col("k") < 10, 0).when(F.col("k") < 13, 10).otherwise(F.col("k")).cast("long")
    members = docs.select(F.lit(99).cast("long").alias("hub"), F.lit(0).cast("long").alias("hub_label"), F.col("k").alias("id"), label.alias("label"))
    links = minhash.compared(members.join(minhash.mixed(members), "hub").join(minhash.shingle_sets(docs, ids, "k", "text"), "id")).collect()
    labels = {r.id: r.label for r in members.collect()}

    def joined(edges):
        root = dict(labels)
        for a, b in edges:
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
        return root

    own = [shingle_list(t) for t in texts]
    want = [(a, b) for a, b in itertools.combinations(range(25), 2) if labels[a] != labels[b] and naive_similarity(own[a], own[b]) >= 0.8]
    assert want and joined([(r.a, r.b) for r in links]) == joined(want) and {(r.a, r.b) for r in links} <= set(want)


def test_texts_of_a_template_are_not_compared_in_pairs(spark):
    """Texts that share less than the threshold with all others leave before blocks are dealt; those that do not stay."""
    tapeworks.distribute(spark)
    common = [f"c{i}" for i in range(70)]
    own = [" ".join([*common, *(f"o{k}x{i}" for i in range(40))]) for k in range(50)]
    docs = spark.createDataFrame(list(enumerate([*own, own[0] + " more", own[1] + " tail"])), "k long, text string")
    ids = docs.select(F.struct(*[c.alias(n) for n, c in minhash.row_key(F.col("k"), F.col("text")).items()]).alias("id"), "k")
    sets = minhash.shingle_sets(docs, ids, "k", "text")
    members = docs.select(F.lit(0).cast("long").alias("hub"), F.col("k").alias("id"), F.col("k").alias("label"))
    assert {r.id for r in minhash.linkable(members, sets).collect()} == {0, 1, 50, 51}


def test_dedup_carries_columns_of_any_name(spark):
    tapeworks.distribute(spark)
    df = spark.createDataFrame([(1, LONG, 5, "a", 7, {"k": 1}), (2, LONG + " end", 6, "b", 8, None)], "doc_id long, text string, __id long, hash string, `a.b` int, row map<string,int>")
    kept = minhash.dedup(df)
    assert kept.columns == df.columns and kept.collect() == df.where("doc_id = 1").collect()


def test_filter_loses_no_candidate(spark, monkeypatch):
    rows = spark.range(-500, 500).union(spark.range(5))
    ids = spark.range(-500, 500).where("id % 8 = 0")
    assert minhash.likely(rows, ids.where("false")).count() == 0
    for bits in (64, 1 << 26):  # full, so that it keeps nearly all, and nearly empty
        monkeypatch.setattr(minhash, "FILTER_BITS", bits)
        kept = minhash.likely(rows, ids)
        assert kept.join(ids, "id", "left_semi").count() == 126
        assert 126 <= kept.count() <= 1005


@pytest.mark.parametrize("block", [256, 5])
def test_blocks_of_a_group_lose_no_link(spark, monkeypatch, block):
    tapeworks.distribute(spark)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"e{k}"] + base[k + 1 :]) for k in range(0, 200, 4)] + [" ".join(base[: 100 + k]) for k in range(0, 100, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", block)
    whole = dict(pairs(minhash.near_duplicates(df), "id", "class_id"))
    sets = [set(shingles.shingle_hashes(shingles.normalise(t)).tolist()) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            assert whole[a] == whole[b]


def naive_bayes(train, text):
    """(language, posterior) by the definition, over the same buckets."""

    def counts(t):
        h = [g[g < langid.BUCKETS] for g in langid.grams([t.lower()])[0]]
        return np.bincount(np.concatenate(h), minlength=langid.BUCKETS)

    logs = {}
    for lang in {x for _, x in train}:
        n = sum(counts(t) for t, x in train if x == lang) + 0.1
        logs[lang] = math.log(sum(x == lang for _, x in train) / len(train)) + counts(text) @ np.log(n / n.sum())
    best = max(sorted(logs), key=logs.get)
    return best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())


@pytest.mark.parametrize(("chars", "languages"), [(1 << 18, 64), (5, 64), (10, 1), (10, 2)])
def test_language_id(spark, docs, empty, chars, languages, monkeypatch):
    monkeypatch.setattr(langid, "CHARS", chars)
    monkeypatch.setattr(langid, "LANG_BLOCK", languages)
    monkeypatch.setattr(langid, "HELD", languages)
    train = [("the cat and the dog are here", "en"), ("a dog", "en"), ("der hund und die katze sind hier", "de"), ("le chien et le chat sont ici", "fr"), ("el perro y el gato", "es"), ("zz", "xx")]
    df = spark.createDataFrame([*train, (None, "fr"), ("x", None)], "text string, lang string")
    model = langid.model_blocks(langid.count_grams(df))
    assert [x for b in model for x in b()[0]] == ["de", "en", "es", "fr", "xx"]
    texts = ["the dog", "die katze und", None, "123 !?", "", "Z", "ch", "et le dog", "und der hund " * 9, "the", "El ici hier a here"]
    test = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.lang_pred, r.score) for r in langid.predict(test, model).collect()}
    for i, t in enumerate(texts):
        want = naive_bayes(train, t) if t and any(map(str.isalpha, t)) else ("und", 0.0)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-3, (t, got[i], want)
    assert langid.predict(empty, model).isEmpty()
    nothing = langid.model_blocks(langid.count_grams(df.limit(0)))
    assert {(r.lang_pred, r.score) for r in langid.predict(test, nothing).collect()} == {("und", 0.0)}


def test_parts_of_long_texts_have_each_gram_once(monkeypatch):
    text = "".join(map(chr, np.random.default_rng(4).integers(97, 110, 103)))
    whole = [np.sort(g[g < langid.BUCKETS]) for g in langid.grams([text])[0]]
    for chars in (1, 2, 3, 10, 101, 102, 103):
        monkeypatch.setattr(langid, "CHARS", chars)
        orders = [[], [], []]
        for _, parts, stop in langid._parts([text]):
            for k, g in enumerate(langid.grams(parts)[0]):
                orders[k].append(g[:stop])
        assert all(np.array_equal(np.sort(g[g < langid.BUCKETS]), w) for g, w in zip(map(np.concatenate, orders), whole, strict=True))


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = pfor.read_documents(pfor.with_starts(pfor.write_segments(docs, path, 2))).collect()
    start, want = 0, []
    for d, x in sorted(source(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert pfor.read_documents(pfor.with_starts(pfor.write_segments(empty, path, 2))).isEmpty()


def test_an_id_of_many_texts_is_dealt(spark):
    path = P.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(None if i % 2 else 5, f"text {i} " * 20) for i in range(400)], "doc_id long, text string").repartition(4)
    segments = pfor.write_segments(df, path, 2, partitions=4)
    assert all(r.n < 200 for r in segments.select(F.size("doc_ids").alias("n")).collect())
    got = pfor.read_documents(pfor.with_starts(segments)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 200 + [5] * 200
    assert all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(got))


def test_texts_over_segments_and_batches(spark, monkeypatch):
    monkeypatch.setattr(pfor, "SEGMENT", 50)
    monkeypatch.setattr(pfor, "BATCH_BYTES", 100)
    path = P.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i, f"some words {i}, and more. " * (i % 7)) for i in range(60)], "doc_id long, text string").coalesce(1)
    enc, start = pfor.PieceEncoder(path).tokenizer, 0
    for r, t in zip(pfor.read_documents(pfor.with_starts(pfor.write_segments(df, path, 2, partitions=2))).orderBy("doc_id").collect(), df.orderBy("doc_id").collect(), strict=True):
        ids = np.array([*enc.encode(t.text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_only_files_that_allow_it_are_cut(tmp_path):
    import json

    import pyarrow as pa

    file = json.loads(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
    assert pfor.cuttable(file)
    texts = ["Some words, And more.\n two  spaces", " lead", ""]
    changes = {"prefix": {"pre_tokenizer": file["pre_tokenizer"] | {"add_prefix_space": True}}, "lower": {"normalizer": {"type": "Lowercase"}}, "none": {"pre_tokenizer": None}}
    for name, change in changes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(file | change), encoding="utf-8")
        encoder = pfor.PieceEncoder(str(path))
        assert not encoder.cuts
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(pa.array(texts))] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("ids", [[0], [7] * 10, [2**32 - 1, 0, 5], list(range(5000)), [1] * 99 + [10**6]])
def test_blocks_round_trip(ids):
    x = np.array(ids, np.uint32)
    assert pfor.unpack(*pfor.pack(x)).tolist() == ids


def test_byte_bpe(docs, empty):
    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    enc = bpe.encoding(path, pattern)
    got = bpe.digests(docs, path, pattern)
    want = []
    for d, x in source(docs):
        ids = np.array(enc.encode_ordinary(x or ""), "<u4").tobytes()
        want.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert pairs(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.digests(empty, path, pattern).isEmpty()


def by_match(enc, text):
    """The ids of each match of the pattern, found by another engine and encoded as a text that is one match."""
    import regex

    one = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), bpe.ALL)
    return [i for m in regex.finditer(P.PATTERN, text) for i in one.encode_ordinary(m[0])]


def test_pieces_of_long_texts_are_safe():
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    one = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), bpe.ALL)
    text = "".join(TEXTS[5:6]) + " don't  stop\n\n 12 34, x\x1c !\x1c\u3000\u3000a\x85\xa0" * 50 + "é" * 200 + " " * 90 + "y\n\n\n"
    for limit in (1, 2, 7, 50):
        parts = list(bpe.pieces(text, limit))
        assert "".join(p for p, _ in parts) == text
        assert [i for p, whole in parts for i in (one if whole else enc).encode_ordinary(p)] == enc.encode_ordinary(text) == by_match(enc, text)


def test_very_long_runs_of_one_kind(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoding(path, P.PATTERN)
    n = 2_000_000
    texts = [" " * n + "x", "a b" + " " * n, "\n" * n + "  z", "\u3000" * (n // 3) + "y", "q" * n, "!" * n, "7" * n, (" " * 70_000 + "w") * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    got = {r.doc_id: r for r in bpe.digests(df, path, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = np.array(by_match(enc, t), "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()), i


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    own = {i: " ".join(f"v{i}q{k}" for k in range(80)) for i in range(60)}
    rows = [(i, f"boiler line for all\n{own[i]}", "en", f"s{i % 4}", 1, "x", 1) for i in range(60)]
    rows += [(100 + i, rows[3][1], "en", "s0", 1, "x", 1) for i in range(5)] + [(200, "too short", "en", "s0", 9, "x", 1), (201, None, None, None, None, None, None), rows[7], (None, own[9] + " tail", "en", None, 1, None, None)]
    item = " ".join(f"bench{k}" for k in range(30))
    rows += [(300, " ".join(f"u{k}" for k in range(100)) + " " + item, "en", "s1", 1, "x", 1), (301, " ".join(f"t{k}" for k in range(700)) + " " + item, "en", "s1", 1, "x", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash string, row int")
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == table.columns, name
    want = {i: own[i] for i in range(60) if i != 9} | {None: own[9] + " tail", 301: " ".join(f"t{k}" for k in range(700)) + " "}
    got = kept.collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want) and all(r.n_chars == len(r.text) for r in got)
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert out.keys() == want.keys()
    for d, t in want.items():
        ids = np.array(enc.encode_ordinary(t), "<u4").tobytes()
        assert (bytes(out[d]["ids"]), out[d].ids_sha256, out[d].decoded_sha256) == (ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    none = table.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).isEmpty(), name
