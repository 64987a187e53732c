"""Conversation prefix trie (operator 12): ROLLUP over positional columns of turn ids.

A conversation is a row of turn ids (MD5 of role and text, with the text's length) in `WIDTH`
columns; a longer one continues in further rows, one for each block of columns, keyed by the node
where the block before ended. One `GROUP BY prior node, ROLLUP(t1, ..., t8)` counts the members of
all prefixes together, and `grouping_id` tells a prefix from a conversation that ended. A second
ROLLUP over the nodes sums what lies below each of them inside its block. What lies in later
blocks is handed up along the chain of blocks by doubling the step, so a conversation of n blocks
takes log2(n) rounds. Texts never move: they are read once and become ids.

A node's key is its depth and two 64-bit sums (exclusive or) of hashes of its turn ids with their
places, so that a parent's key follows from the child's. Members that end at a node are joined to
text pieces where they stand sorted; only pieces come together, in order, for the node's digest.

Rows are ordered by turn (null first), then role, then the digest of role and text; a null role or
text is empty; repeated rows are repeated turns. Rows without a conversation id belong to no
conversation. Ids are cut down to hundreds towards zero. An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tapeworks.llm.common import discard, scratch, table
from tapeworks.llm.native import text_of

WIDTH = 8
SHARED, FAMILY = 6, 100
#: Turn numbers that one window holds, and characters of a piece of joined ids.
NUMBERS_LOG2, PIECE = 10, 1 << 16
T = [f"t{i + 1}" for i in range(WIDTH)]
KEY = ["depth", "k1", "k2"]
NONE = hashlib.sha256(b"").hexdigest()


def ordered_turns(rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv, pos, id, chars): each turn's place from 1, its id and its text's code points.

    Places are counted inside ranges of turn numbers, after the rows of the ranges before, so a conversation of very many turns is not one task's work.
    """
    role, text = text_of(F.col(role_column)), text_of(F.col(text_column))
    told = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.col(turn_column).cast("long")
    range_ = F.coalesce(F.shiftright(turn, NUMBERS_LOG2), F.lit(-(2**62)))
    turns = rows.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("conv"), range_.alias("range"), turn.alias("turn"), role.alias("role"), told.alias("id"), F.length(text).cast("long").alias("chars"))
    turns = scratch(turns, "turns")
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = turns.groupBy("conv", "range").count().select("conv", "range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv", "range").orderBy(F.asc_nulls_first("turn"), "role", "id"))
    placed = turns.withColumn("nth", inside).join(before, ["conv", "range"])
    return placed.select("conv", (F.col("before") + F.col("nth")).alias("pos"), "id", "chars")


def rebuilt(turns: DataFrame, shared: int = SHARED, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their hundred: (conv, pos, id, chars) and (conv, length), turnless ones included.

    The first h turns are those of the conversation whose id is c - c % family, h = crc32(c) % shared; then come c's own after its first h.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    heads = turns.where(F.col("pos") < shared).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "chars"))).alias("head"))  # shared - 1 at most
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    convs = sizes.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    convs = convs.join(heads.withColumnRenamed("conv", "base"), "base", "left").withColumn("head", F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h"))))
    convs = convs.withColumn("n_head", F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    convs = scratch(convs.select("conv", "h", "head", "n_head", (F.col("n_head") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length")), "convs")
    tail = turns.join(convs.select("conv", "h", "n_head"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "id", "chars")
    head = convs.select("conv", F.explode("head").alias("e")).select("conv", "e.pos", "e.id", "e.chars")
    return head.unionByName(tail), convs.select("conv", "length")


def _hashes(depth: Column, id_: Column) -> list[Column]:
    return [F.xxhash64(depth.cast("long"), id_), F.xxhash64(id_, depth.cast("long"), F.lit(1))]


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv, block, p1, p2, t1.., x1, x2): a conversation's turns by WIDTH, the key before the block and at its end."""
    block, place = F.floor((F.col("pos") - 1) / WIDTH), F.col("pos") - 1
    x = _hashes(F.col("pos"), F.col("id"))
    rows = turns.select("conv", block.alias("block"), F.struct(place.alias("place"), "id", "chars").alias("turn"), x[0].alias("x1"), x[1].alias("x2"))
    rows = rows.groupBy("conv", "block").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    so_far = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = {f"e{i}": F.bit_xor(f"x{i}").over(so_far) for i in (1, 2)}
    rows = rows.withColumns(ends).withColumns({f"p{i}": F.col(f"e{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)})
    turn = lambda k: F.get("turns", F.lit(k))
    return rows.select("conv", "block", "p1", "p2", *[F.when(turn(k).isNotNull(), F.struct(turn(k)["id"].alias("id"), turn(k)["chars"].alias("chars"))).alias(t) for k, t in enumerate(T)], "e1", "e2", F.size("turns").alias("n_turns"))


def _rolled(rows: DataFrame, sums: str) -> DataFrame:
    """The sums for each prefix of each block: j turns of t1.. count (0: all of the block together)."""
    out = rows.sparkSession.sql(f"SELECT block, p1, p2, {', '.join(T)}, grouping_id() AS g, {sums} FROM {{rows}} GROUP BY block, p1, p2, ROLLUP({', '.join(T)})", rows=rows)
    out = out.withColumn("j", (F.lit(WIDTH) - F.log2(F.col("g") + 1).cast("int")).cast("int"))
    out = out.withColumn("last", F.get(F.array(*T), F.col("j") - 1)).where("j = 0 or last is not null")
    keys = [F.col("p1"), F.col("p2")]
    for i, t in enumerate(T):
        x = _hashes(F.col("block") * WIDTH + i + 1, F.col(f"{t}.id"))
        keys = [k.bitwiseXOR(F.when(F.col("j") > i, h).otherwise(F.lit(0).cast("long"))) for k, h in zip(keys, x, strict=True)]
    return out.withColumns({"depth": (F.col("block") * WIDTH + F.col("j")).cast("long"), "k1": keys[0], "k2": keys[1]}).drop("g")


def _ends(convs: DataFrame) -> DataFrame:
    """(depth, k1, k2, n_ends, sha) from (depth, k1, k2, conv): how many conversations end at a node, and the digest of their ids in order."""

    def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, ids, chars = None, [], 0

        def done() -> None:
            if ids:
                rows.append((*key, ids[0], len(ids), ",".join(map(str, ids))))

        for batch in it:
            for *k, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key or chars > PIECE:
                    done()
                    key, ids, chars = k, [], 0
                ids.append(conv)
                chars += len(str(conv)) + 1
            yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "first", "n", "piece"), r, strict=True)) for r in rows], PIECES)
            rows.clear()
        done()
        yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "first", "n", "piece"), r, strict=True)) for r in rows], PIECES)

    def digested(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, digest = None, 0, None
        for batch in it:
            rows = []
            for *k, _, count, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        rows.append((*key, n, digest.hexdigest()))
                    key, n, digest = k, 0, hashlib.sha256()
                elif n:
                    digest.update(b",")
                digest.update(piece.encode())
                n += count
            yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "n_ends", "sha"), r, strict=True)) for r in rows], ENDS)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "n_ends", "sha"), (*key, n, digest.hexdigest()), strict=True))], ENDS)

    longs = [(k, pa.int64()) for k in KEY]
    PIECES = pa.schema([*longs, ("first", pa.int64()), ("n", pa.int64()), ("piece", pa.string())])
    ENDS = pa.schema([*longs, ("n_ends", pa.int64()), ("sha", pa.string())])
    types = ", ".join(f"{k} long" for k in KEY)
    pieces = convs.select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(joined, f"{types}, first long, n long, piece string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digested, f"{types}, n_ends long, sha string")


def _below(nodes: DataFrame) -> DataFrame | None:
    """(depth, k1, k2, saved, leaves): for each node at which a block begins, the sums over all blocks below it; None if no conversation has a second block."""
    later = nodes.where("block > 0")
    if later.isEmpty():
        return None
    sums = later.groupBy((F.col("block") * WIDTH).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    above = F.when(F.col("block") > 0, F.struct((F.col("block") * WIDTH).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")))
    now = scratch(nodes.where(F.col("j") == WIDTH).select(*KEY, above.alias("above")).join(sums, KEY).select(F.struct(*KEY).alias("key"), "above", "saved", "leaves"), "below")
    while True:
        # sums reach twice as far in each round: those of the nodes exactly as far below come on top
        got = now.where("above is not null").groupBy(F.col("above").alias("key")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        jump = now.select(F.col("key").alias("above"), F.col("above").alias("further"))
        out = now.join(got, "key", "left").join(jump, "above", "left")
        out = scratch(out.select("key", F.col("further").alias("above"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")), "below")
        discard(now)
        now = out
        if now.where("above is not null").isEmpty():
            return now.select("key.*", F.col("saved").alias("below_saved"), F.col("leaves").alias("below_leaves"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of conversations. turns: conv, pos from 1, id, chars; convs: conv and length, turnless ones too.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (code points that sharing each node saves, over the subtree), ends_sha256.
    """
    blocks = scratch(_blocks(turns), "blocks")
    counted = _rolled(blocks, "count(*) AS n_convs, min(conv) AS conv_id").where("j > 0")
    up = [k.bitwiseXOR(x) for k, x in zip((F.col("k1"), F.col("k2")), _hashes(F.col("depth"), F.col("last.id")), strict=True)]
    nodes = counted.select("block", "p1", "p2", *T, "j", *KEY, up[0].alias("q1"), up[1].alias("q2"), "n_convs", "conv_id", F.col("last.chars").alias("chars"))

    zero = F.lit(0).cast("long")
    last = blocks.join(convs, "conv").where(F.col("length") == F.col("block") * WIDTH + F.col("n_turns")).select(F.col("length").alias("depth"), F.col("e1").alias("k1"), F.col("e2").alias("k2"), "conv")
    ended = _ends(last.unionByName(convs.where("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv")))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(-1).cast("long").alias("block"), *[zero.alias(c) for c in ("p1", "p2")], F.lit(0).alias("j"), *[zero.alias(c) for c in (*KEY, "q1", "q2")], "n_convs", "conv_id", zero.alias("chars"))
    ended = scratch(ended, "ends")
    nodes = nodes.unionByName(root, allowMissingColumns=True).join(ended, KEY, "left")
    own = [((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_convs") == F.coalesce("n_ends", zero)).cast("long").alias("leaves")]
    nodes = scratch(nodes.select("block", "p1", "p2", *T, "j", *KEY, "q1", "q2", "n_convs", "conv_id", F.coalesce("sha", F.lit(NONE)).alias("sha"), *own), "nodes")

    inner = nodes.where("j > 0")
    below = _below(inner)
    if below is not None:
        inner = inner.join(below, KEY, "left").withColumns({n: F.col(n) + F.coalesce(f"below_{n}", zero) for n in ("saved", "leaves")})
    sums = _rolled(inner.select("block", "p1", "p2", *T, "saved", "leaves"), "sum(saved) AS saved_tokens, sum(leaves) AS n_leaves").where("j > 0 or block = 0")
    kids = inner.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    facts = scratch(nodes.select(*KEY, "q1", "q2", "n_convs", "conv_id", "sha").join(sums.select(*KEY, "saved_tokens", "n_leaves"), KEY, "left").join(kids, KEY, "left"), "facts")
    discard(blocks, ended, *([below] if below is not None else []))
    out = facts.join(parents, ["depth", "q1", "q2"], "left")
    # without a node below it, the root is the one leaf
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.col("sha").alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ordered_turns(table(spark, sf_dir, "conversations"))
    turns = scratch(placed, "ordered")
    discard(placed)
    rows, convs = rebuilt(turns)
    out = prefix_trie(rows, convs)
    discard(rows)
    return out


#: crc32 as a fold over bytes; a node is the joined digests of its turns, 32 characters each.
OP12_SQL = r"""
WITH RECURSIVE steps AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(r), id) AS pos, id, length(x) AS chars
  FROM (SELECT conv_id, turn, r, x, md5(length(r) || ':' || r || x) AS id FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL))),
convs AS (SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(list_transform(range(strlen(CAST(c AS VARCHAR))), lambda i: ascii(substr(CAST(c AS VARCHAR), i + 1, 1))::BIGINT), lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8), 4294967295::BIGINT)) % 6 AS h FROM (SELECT DISTINCT c FROM own), crcs),
heads AS (SELECT v.c, o.pos, o.id, o.chars FROM convs v JOIN own o ON o.c = v.base AND o.pos <= v.h),
turns AS (SELECT * FROM heads UNION ALL SELECT o.c, o.pos - h + coalesce(n, 0), o.id, o.chars FROM own o JOIN convs v ON o.c = v.c LEFT JOIN (SELECT c, count(*) AS n FROM heads GROUP BY c) x ON x.c = o.c WHERE o.pos > h),
members AS (SELECT c, pos AS d, string_agg(id, '') OVER (PARTITION BY c ORDER BY pos) AS k, chars FROM turns UNION ALL SELECT c, 0, '', 0 FROM convs),
lengths AS (SELECT c, max(d) AS l FROM members GROUP BY c),
nodes AS (SELECT d, k, left(k, CAST(greatest(0, length(k) - 32) AS BIGINT)) AS p, count(*) AS n, min(c) AS c, any_value(chars) AS chars FROM members GROUP BY d, k),
ends AS (SELECT k, sha256(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c)) AS sha FROM members m JOIN lengths l ON m.c = l.c AND m.d = l.l GROUP BY k),
kids AS (SELECT p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY p),
facts AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids ON kids.p = n.k),
sums AS (SELECT a.k, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.chars) AS saved FROM facts a JOIN facts b ON starts_with(b.k, a.k) GROUP BY a.k)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, q.c AS parent_conv_id, f.n AS n_convs, CAST(f.n_children AS BIGINT) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM facts f JOIN sums s ON f.k = s.k LEFT JOIN ends e ON e.k = f.k LEFT JOIN nodes q ON f.d > 0 AND q.k = f.p
"""
