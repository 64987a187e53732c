"""Token ids in patched frame-of-reference blocks (operator 9).

File format. A table of segments, each a row of a Parquet file (so that any store Spark can
write holds it, and a lost executor's file is written again by Spark's commit protocol):

* part, segment: place in the order of the whole; start: ids before the segment, of all documents
* doc_ids, lengths: the documents of the segment, whole, and how many ids each has (the
  smallest 64-bit integer stands for a null id)
* n_ids; index: for each block of `BLOCK` ids the byte at which it starts in payload, u32
* payload: the blocks, one after another. A block: u32 minimum; u16 count; u8 width w;
  u8 zero; u16 number of exceptions; then w bit planes of ceil(count / 8) bytes, lowest bit
  first (the low w bits of id - minimum); then the exceptions' positions, u16, and their
  id - minimum, u32. All little-endian.

The width is that of the value at `PERCENTILE` per cent of a block's sorted differences; larger
differences are exceptions.

Documents are range-partitioned by doc_id (null first, repeated ids next to each other, ties by
hash of the text, so that an id of very many texts is dealt too) and sorted inside each partition,
so ids are in ascending doc_id order; a segment holds `SEGMENT` ids or one document. Null and empty
texts have the end id alone. An empty table gives no segments. Other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import from_key, id_key, runs_of_chars, scratch, table

BLOCK = 4096
SEGMENT = 1 << 19
PERCENTILE = 95
HEAD = struct.Struct("<IHBBH")
CACHE_PIECES = 600_000
BATCH_BYTES = 16 << 20
#: Texts that are not cut: white space other than single spaces or line feeds between other characters, the mark of a cut, or an added token's start. (RE2; its \s is ASCII.)
_ODD = r"[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$|<\|"
#: A comma or full stop after anything but a letter or digit.
_ADJACENT = r"[^\pL\pN][.,]"
_CUT = "\x01"


def pack_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    diff = (ids - np.uint32(low)).astype(np.uint32)
    at = min(len(diff) - 1, len(diff) * PERCENTILE // 100)
    width = int(np.partition(diff, at)[at]).bit_length()
    over = np.flatnonzero(diff >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    planes = np.packbits(((diff[None, :] >> np.arange(width, dtype=np.uint32)[:, None]) & np.uint32(1)).astype(np.uint8), axis=1).tobytes()
    return HEAD.pack(low, len(diff), width, 0, len(over)) + planes + over.astype("<u2").tobytes() + diff[over].astype("<u4").tobytes()


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    low, n, width, _, n_over = HEAD.unpack_from(data, at)
    at += HEAD.size
    stride = (n + 7) // 8
    out = np.zeros(n, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, width * stride, at).reshape(width, stride), axis=1, count=n)
    for k in range(width):
        out |= bits[k].astype(np.uint32) << np.uint32(k)
    at += width * stride
    if n_over:
        out[np.frombuffer(data, "<u2", n_over, at)] = np.frombuffer(data, "<u4", n_over, at + 2 * n_over)
    return out + np.uint32(low)


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(index, payload) of a segment's ids."""
    blocks = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    return starts.astype("<u4").tobytes(), b"".join(blocks)


def unpack(index: bytes, payload: bytes) -> np.ndarray:
    starts = np.frombuffer(index, "<u4")
    return np.concatenate([unpack_block(payload, int(i)) for i in starts]) if len(starts) else np.zeros(0, np.uint32)


def cuttable(file: dict) -> bool:
    """Whether a tokenizer file has what `PieceEncoder` needs to cut texts: byte-level words by the usual pattern, no normaliser, and added tokens that begin with <| only."""
    pre = file.get("pre_tokenizer") or {}
    words = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return bool(words and not file.get("normalizer") and all(t["content"].startswith("<|") and not (t.get("lstrip") or t.get("rstrip")) for t in file.get("added_tokens") or []))


class PieceEncoder:
    """Encodes texts by a byte-level BPE of the tokenizers library, each distinct piece of a batch once.

    The pre-tokeniser never joins characters across a single space or line feed that stands
    between two others: a word takes at most the space before it. So a text without other
    white space is cut there, its pieces are encoded by the library, and their ids follow
    each other as in the whole text. It is also cut before commas and full stops, if none of
    them follows another sign, with which it would be one. Any other text goes to the library
    whole; so does every text if the file is for another pre-tokeniser, has a normaliser, or has added
    tokens that cutting could break.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = cuttable(json.loads(Path(path).read_text(encoding="utf-8")))
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0] if self.cuts else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, u32, none null. Unless the file forbids it, texts are cut and their distinct pieces found in Arrow; a piece is looked up once for all texts."""
        if not self.cuts:
            return self._whole(texts.to_pylist())
        odd = pc.match_substring_regex(texts, _ODD)
        cut = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", texts), " ", _CUT + " "), "\n", f"{_CUT}\n{_CUT}")
        more = pc.replace_substring(pc.replace_substring(cut, ",", _CUT + ","), ".", _CUT + ".")
        pieces = pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, _ADJACENT), cut, more), _CUT)
        coded = pc.dictionary_encode(pieces.flatten())
        found = self._ids(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        place = coded.indices.to_numpy()
        n = sizes[place]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - (np.cumsum(sizes) - sizes)[place], n)]
        bounds = np.concatenate(([0], ends))[pieces.offsets.to_numpy()]
        out = [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[i] = self._whole([texts[int(i)].as_py()])[0]
        return out

    def _ids(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct pieces; when the table is full, those not asked for since it was last full go."""
        if len(self.known) > CACHE_PIECES:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = []
        for p in parts:
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    missing.append(p)
        if missing:
            known.update(zip(missing, self._lines(missing), strict=True))
        return [known[p] for p in parts]

    def _lines(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, from one call: a line feed between two parts is a token of its own."""
        parts_of_text = [p for p in parts if p and "\n" not in p]
        ids = np.array(self.tokenizer.encode("\n".join(parts_of_text), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(ids == self.line_feed)
        if len(cuts) != max(0, len(parts_of_text) - 1):
            return self._whole(parts)
        starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
        found = {p: ids[a:b].tobytes() for p, a, b in zip(parts_of_text, starts, ends, strict=True)} if parts_of_text else {}
        return [b"" if not p else found[p] if p in found else self._whole([p])[0] for p in parts]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
    return PieceEncoder(path)


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", partitions: int | None = None) -> DataFrame:
    """The segments of docs in ascending id order, written under the shared folder; start is within the part."""
    rows = docs.select(id_key(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "id", "hash").sortWithinPartitions("id", "hash", "text").select("id", "text", F.spark_partition_id().alias("part"))
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("index", pa.binary()), ("payload", pa.binary())])

    def segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, segment, start = encoder(tokenizer_path), 0, 0
        held: list[bytes] = []
        names: list[int] = []
        part, size = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, names, segment, start, size
            ids = np.frombuffer(b"".join(held), "<u4")
            index, payload = pack(ids)
            row = {"part": part, "segment": segment, "start": start, "n_ids": len(ids), "doc_ids": names, "lengths": [len(x) // 4 for x in held], "index": index, "payload": payload}
            segment, start, held, names, size = segment + 1, start + len(ids), [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in it:
            texts = batch.column(1)
            for a, b in runs_of_chars(pc.binary_length(texts).to_pylist(), BATCH_BYTES):
                for key, p, got in zip(batch.column(0)[a:b].to_pylist(), batch.column(2)[a:b].to_pylist(), enc.encode(texts[a:b]), strict=True):
                    ids = got + end
                    if held and size + len(ids) // 4 > SEGMENT:
                        yield flush()
                    part = p
                    held.append(ids)
                    names.append(key)
                    size += len(ids) // 4
        if held:
            yield flush()

    kept = ordered.mapInArrow(segments, "part int, segment int, start long, n_ids long, doc_ids array<long>, lengths array<long>, index binary, payload binary")
    return scratch(kept, "segments")


def with_starts(segments: DataFrame) -> DataFrame:
    """Adds to each segment's start the ids of all parts before its own (a sum over one row a part, broadcast: as many rows as the files have parts)."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("offset"))
    return segments.join(F.broadcast(offsets), "part").withColumn("start", F.col("start") + F.col("offset")).drop("offset")


def read_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the blocks."""

    def documents(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples(index=False):
                data = unpack(row.block_index, row.payload).astype("<u4").tobytes()
                lengths = np.asarray(row.lengths, np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": row.doc_ids, "start": starts + row.start, "n_tokens": lengths, "ids_crc32": crc})

    needed = segments.select("start", "doc_ids", "lengths", F.col("index").alias("block_index"), "payload")
    return needed.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", from_key("doc_id"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    segments = write_segments(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_documents(with_starts(segments))
