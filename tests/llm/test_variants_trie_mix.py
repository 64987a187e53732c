"""Operators 11 to 13 against brute force, and their stated cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import tapeworks
from tapeworks.llm import mixing, spelling, trie

DOCS = "doc_id long, text string, source string, word string, n long"


def docs(spark, rows):
    """rows: (doc_id, text, source); two more columns have names that the operators use themselves."""
    tapeworks.distribute(spark)
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(3)


# Spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for doc, text, _ in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                w = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                n[w] += len(w) >= 7
                run = ""
    words = {w: k for w, k in n.items() if k >= 2}
    form, out = {}, set()
    for w in words:
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
        out.add((w, len(others)))
    rows = set()
    for w, k in out:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, words[w], k, words[form[w]] if form[w] else None))
    return rows


@pytest.mark.parametrize("group", [20_000, 8])
def test_variants_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    rnd = random.Random(5)
    base = ["".join(rnd.choices("aeinrstéàÉß×", k=rnd.randint(6, 10))) for _ in range(40)] + ["aaaaaaaaaa", "aaaaaaaaab", "z" * 400, "z" * 399 + "y"]
    rows = []
    for i in range(400):
        w = [rnd.choice(base) for _ in range(12)]
        for j in range(0, 12, 3):
            k = rnd.randrange(len(w[j]))
            w[j] = rnd.choice([w[j], w[j].upper(), w[j][:k] + w[j][k + 1 :], w[j][:k] + "q" + w[j][k:], w[j][:k] + "e" + w[j][k + 1 :]])
        rows.append((i, rnd.choice([" ", "-", "\n", "中", "1"]).join(w), "s"))
    rows += [(None, "nothing nothing", "s"), (7, None, "s"), (8, "", "s"), (9, "abcdefg" * 3, None)] + [rows[3]] * 2
    got = [tuple(r) for r in spelling.variants(docs(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_variants(rows)
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_are_found_once_over_many_leaves(monkeypatch):
    monkeypatch.setattr(spelling, "LEAF", 4)
    rnd = random.Random(1)
    words = {n: sorted({"".join(rnd.choices("abcé", k=n)) for _ in range(150)}) for n in (4, 5)}
    rows = {n: spelling.letters(w) for n, w in words.items()}
    found = Counter()
    for kind, i, j in spelling.pairs_of_group(rows[5], np.zeros((0, 5), np.uint8), rows[4]):
        for a, b in zip(i, j, strict=True):
            found[frozenset((words[5 if kind == "members" else 4][a], words[5][b]))] += 1
    want = {frozenset((a, b)) for a in words[4] + words[5] for b in words[5] if near(a, b)}
    assert set(found) == want and set(found.values()) == {1}


def test_chains_of_forms_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    rows = [(1, " ".join(["letters"] * 2 + ["lettera"] * 30 + ["lettara"] * 400), "s")]
    out = {r.word: r for r in spelling.variants(docs(spark, rows), slips=False).collect()}
    assert (out["letters"].form, out["letters"].root, out["letters"].n_near) == ("lettera", "lettara", 1)
    assert (out["lettara"].form, out["lettara"].root, out["lettara"].n) == (None, "lettara", 400)
    assert spelling.variants(docs(spark, rows).where("false")).isEmpty()


# Prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), role.encode(), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, d == len(seq)))
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = ",".join(str(c) for c, end in sorted(m) if end)
        out.append((min(m)[0], len(k), min(members[k[:-1]])[0] if k else None, len(m), kids[k], sum(not kids[x] for x in below), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def run_trie(spark, rows):
    tapeworks.distribute(spark)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, t1 string")
    turns, convs = trie.rebuilt(trie.ordered_turns(df.repartition(3)))
    return sorted((tuple(r) for r in trie.prefix_trie(turns, convs).select(*COLUMNS).collect()), key=repr)


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 10)
    rnd = random.Random(3)
    rows = []
    for c in [*range(0, 14), *range(100, 108), 250, 251]:
        said = rnd.choice([1, 2])  # many conversations are alike
        for turn in range(rnd.choice([1, 2, 3, 5, 9])):
            rows.append((c, turn, ("user", "assistant", None)[turn % 2 if turn < 8 else 2], rnd.choice([f"{said} says {turn // 2}", None, "", "ünder"]) if turn > 2 else f"{said} says {turn}"))
    for c in (5, 6, 105):  # longer than three blocks of columns, over several ranges of turn numbers, and parting late
        rows += [(c, 900 + i * 7, "user", f"long {i}" if i < 27 or c == 5 else f"other {i} {c}") for i in range(36)]
    rows += [(3, None, "user", "first"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "user", "another tie"), (3, -5, "user", "before"), (None, 1, "user", "nobody")]
    got = run_trie(spark, rows)
    assert got == brute_trie(rows) and max(r[1] for r in got) > 24


def test_trie_without_turns(spark):
    # 100 is absent, so those that are shorter than their shared part have no turns at all
    short = [c for c in range(101, 140) if zlib.crc32(str(c).encode()) % 6 > 1][:3]
    rows = [(c, 0, "user", "gone") for c in short]
    assert run_trie(spark, rows) == brute_trie(rows) and len(brute_trie(rows)) == 1
    assert run_trie(spark, []) == []


# Mixing


def test_seats_equal_the_ordered_quotients(spark):
    rnd = random.Random(4)
    rows, house = [], []
    for g in range(12):
        n = rnd.choice([1, 2, 7, 40])
        votes = [rnd.choice([0.0, 1.0, 1.0, rnd.uniform(0, 100), rnd.uniform(0, 1e6)]) for _ in range(n)]
        seats = rnd.choice([0, 1, n, 10 * n, 1000])
        rows += [(g, i, v, 10**9) for i, v in enumerate(votes)]
        house.append((g, seats))
    got = {(r.g, r.party): r.seats for r in mixing.sainte_lague(spark.createDataFrame(rows, "g int, party long, votes double, most long"), spark.createDataFrame(house, "g int, seats long")).collect()}
    for g, seats in house:
        votes = [r[2] for r in rows if r[0] == g]
        have = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * have[i] + 1), -i))
            have[k] += 1
        assert [got.get((g, i), 0) for i in range(len(votes))] == have


def brute_targets(size):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(size.values()), {}
    while len(fixed) < len(size):
        share = (total - sum(fixed.values())) / sum(weight[s] for s in size if s not in fixed)
        above = {s: 3 * size[s] for s in size if s not in fixed and share * weight[s] > 3 * size[s]}
        if not above:
            return {s: fixed.get(s, share * weight[s]) for s in size}
        fixed |= above
    return fixed


def test_the_mix_keeps_its_promises(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 7, 60, 400])), rnd.choices(["a", "b", "Z", "é", None, "c"], [1, 2, 4, 8, 12, 60])[0]) for i in range(3000)]
    rows += [(None, "one two\tthree", "a"), (5, None, "b"), (6, "", None), (7, "w " * 30000, "c"), rows[10], rows[10]]
    out = mixing.mix(docs(spark, rows)).collect()
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    assert Counter((r.doc_id, r.size) for r in out) == Counter((d, len((t or "").split())) for d, t, _ in rows)
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(size)
    for s in size:
        assert {r.source_size for r in out if r.source == s} == {size[s]}
        assert abs(target[s] - want[s]) < 1e-6 * (1 + want[s]) and abs(taken[s] - want[s]) <= 0.01 * want[s] + 1
    assert abs(sum(target.values()) - sum(size.values())) < 1e-3


def test_mixes_of_little(spark):
    assert mixing.mix(docs(spark, []).where("false")).isEmpty()
    (r,) = mixing.mix(docs(spark, [(1, None, None)])).collect()
    assert (r.size, r.source_size, r.target, r.taken) == (0, 0, 0.0, 0)
    out = mixing.mix(docs(spark, [(1, "a b c", "x"), (2, None, "y"), (3, "a", "z")])).collect()
    assert sum(r.taken for r in out) == 4 and all(r.taken <= 3 * r.size for r in out)
