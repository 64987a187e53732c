"""Byte-level BPE encoding and decoding (operator 10) by the tiktoken library and a local rank file.

Texts longer than `SPLIT_CHARS` are cut, before they are encoded, at places that no match of
the pattern can cross: where white space follows another character. (Letters, digits and other
signs match white space at the start only, and white space in front of a match begins one.) The
parts are then encoded one by one and give the ids of the whole.

A run of `SPLIT_CHARS` or more white space would overflow the stack of the library's matcher. The
pattern makes of it one match, without the last character if another character follows; so that
match is given to an encoding whose pattern takes all it gets. Long runs of letters, digits or
signs are one match too, which the library's matcher takes in one step.

Null and empty texts have no ids and decode to no bytes. Rows are independent: repeated rows
give repeated results, other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import table

SPLIT_CHARS = 1 << 16
#: What the pattern's \s stands for (Unicode's White_Space).
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
#: The pattern of an encoding for texts that are one match already.
ALL = "(?s:.+)"


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The tiktoken encoding of a rank file, made once in each Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = SPLIT_CHARS) -> Iterator[tuple[str, bool]]:
    """text in parts of about limit characters, cut at safe places only; True for parts that are one match, which may be longer."""
    start = 0
    runs = re.finditer(f"[{_WHITE}]{{{limit},}}", text) if len(text) > limit else ()
    for run in runs:
        if run.end() - run.start() > 1:
            stop = run.end() if run.end() == len(text) else run.end() - 1
            yield from ((p, False) for p in _cut(text[start : run.start()], limit))
            yield text[run.start() : stop], True
            start = stop
    yield from ((p, False) for p in _cut(text[start:] if start else text, limit))


def _cut(text: str, limit: int) -> Iterator[str]:
    at = 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:] if at else text


def encoded(it: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(id, n_tokens, ids) of batches of (id, text)."""
    import numpy as np

    by_match, one_match = encoding(ranks_path, pattern), encoding(ranks_path, ALL)
    for batch in it:
        out = []
        for text in batch.column(1):
            parts = ((one_match if one else by_match).encode_to_numpy(p, disallowed_special=()) for p, one in pieces(text.as_py() or ""))
            out.append(b"".join(np.asarray(x, dtype="<u4").tobytes() for x in parts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], ["id", "n_tokens", "ids"])


def decoded(it: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """The batches of `encoded` with a column more, decoded."""
    import numpy as np

    enc = encoding(ranks_path, pattern)
    for batch in it:
        out = [enc.decode_bytes(np.frombuffer(x.as_py(), "<u4").tolist()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["id", "n_tokens", "ids", "decoded"])


def _texts(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary"


def encode(df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian unsigned 32-bit integers, for every row of df."""
    rows, schema = _texts(df, id_column, text_column)
    return rows.mapInArrow(lambda it: encoded(it, ranks_path, pattern), schema)


def decode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The frame of `encode` with a column more, decoded: the raw bytes of the ids, valid UTF-8 or not."""
    return df.mapInArrow(lambda it: decoded(it, ranks_path, pattern), f"id {df.schema['id'].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """decode(encode(df)), in one Python worker a task instead of two: a worker keeps its encodings and its memory for later tasks."""
    rows, schema = _texts(df, id_column, text_column)
    return rows.mapInArrow(lambda it: decoded(encoded(it, ranks_path, pattern), ranks_path, pattern), f"{schema}, decoded binary")


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, from the encoded and again decoded text; ids too, if asked for."""
    if ranks_path is None or pattern is None:
        import public_tokenizers

        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    out = round_trip(docs, ranks_path, pattern)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", *(["ids"] if keep_ids else []), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
