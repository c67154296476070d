"""Token ids as directly addressable codes, in files that give any token without decoding a block.

An id is split into chunks of 8 bits, lowest first. Level 0 has the first chunk of every id; level k has a chunk of each
id that goes on after level k - 1, which that level's continuation bitmap tells. A rank directory (bits set before every
512th place) turns a place in a level into a place in the next, so an id is read by a few lookups.

Files are Parquet tables, written by Spark. A row is a segment: the ids of some consecutive documents in ascending
doc_id order. ``body`` holds, little-endian: magic ``DAC1``, documents (u32), tokens (u32), levels (u32); doc_ids (i64)
with a null mask (u8), document ends (u32); then for each level its number of chunks (u32), the chunks (u8), the bitmap
(u8, low bit first) and the rank directory (u32). ``part`` and ``seq`` order the segments; ``before`` counts the part's
tokens before the segment.

A null text is empty (only the end id is written); a null doc_id comes first; equal ids go by a hash of their texts;
repeated rows are kept; an empty table gives a table without rows. Texts are encoded whole, however long: a document of more
tokens than a segment's share is a segment of its own. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir
from tidemark.llm.tokens import encoder, vocabulary

VOCABULARY, END = "byte_bpe_50k.json", 2
STEP = 512  # places for each entry of a rank directory
SEGMENT_TOKENS = 1 << 18
SEGMENT = "part int, seq int, before long, n_docs int, n_tokens long, body binary"


class Level:
    """Chunks of one level, their continuation bitmap and its rank directory."""

    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bitmap, self.ranks = chunks, bitmap, ranks

    def rank(self, i: int) -> int:
        """Bits set before place ``i``."""
        block = i // STEP
        bits = np.unpackbits(self.bitmap[block * STEP // 8 : (i + 7) // 8], bitorder="little")[: i - block * STEP]
        return int(self.ranks[block]) + int(bits.sum())

    def goes_on(self, a: int, b: int) -> np.ndarray:
        return np.unpackbits(self.bitmap[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)


def to_levels(ids: np.ndarray) -> list[Level]:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks, more = (rest & 255).astype(np.uint8), rest >> 8 > 0
        counts = np.add.reduceat(more, np.arange(0, len(more), STEP)) if len(more) else np.zeros(0, int)
        levels.append(Level(chunks, np.packbits(more, bitorder="little"), np.concatenate([[0], np.cumsum(counts)]).astype("<u4")))
        rest = rest[more] >> 8
        if not len(rest):
            return levels


def token_at(levels: list[Level], i: int) -> int:
    """The id at place ``i``."""
    value, shift = 0, 0
    for level in levels:
        value |= int(level.chunks[i]) << shift
        if not level.bitmap[i // 8] >> i % 8 & 1:
            break
        i, shift = level.rank(i), shift + 8
    return value


def tokens_between(levels: list[Level], a: int, b: int) -> np.ndarray:
    """The ids at places ``a`` to ``b``, end exclusive; nothing outside is decoded."""
    out = np.zeros(b - a, np.uint32)
    where, shift = np.arange(b - a), 0
    for level in levels:
        out[where] |= level.chunks[a:b].astype(np.uint32) << np.uint32(shift)
        on = level.goes_on(a, b)
        where, shift = where[on], shift + 8
        if not len(where):
            break
        a = level.rank(a)
        b = a + len(where)
    return out


def pack_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    ends = np.cumsum([len(x) // 4 for x in ids]).astype("<u4")
    levels = to_levels(np.frombuffer(b"".join(ids), "<u4"))
    head = b"DAC1" + np.array([len(doc_ids), ends[-1], len(levels)], "<u4").tobytes()
    names = np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    body = b"".join(np.array([len(v.chunks)], "<u4").tobytes() + v.chunks.tobytes() + v.bitmap.tobytes() + v.ranks.tobytes() for v in levels)
    return head + names + ends.tobytes() + body


def open_segment(body: bytes) -> tuple[list[int | None], np.ndarray, list[Level]]:
    """doc_ids, document ends and levels of a segment; arrays are views of ``body``."""
    if body[:4] != b"DAC1":
        raise ValueError("not a segment of token codes")
    n_docs, _, n_levels = map(int, np.frombuffer(body, "<u4", 3, 4))
    at = 16

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, n, at)
        at += out.nbytes
        return out

    names, null = take("<i8", n_docs), take("u1", n_docs)
    ends = take("<u4", n_docs)
    levels = []
    for _ in range(n_levels):
        n = int(take("<u4", 1)[0])
        levels.append(Level(take("u1", n), take("u1", (n + 7) // 8), take("<u4", (n + STEP - 1) // STEP + 1)))
    return [None if gone else int(x) for x, gone in zip(names, null, strict=True)], ends, levels


def write_codes(docs: DataFrame, path: str, name: str = VOCABULARY, end: int = END) -> None:
    """Encode every text and write the segments, in ascending doc_id order."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text_hash = F.xxhash64("text")
    rows = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id"), text_hash).sortWithinPartitions("doc_id", text_hash).select(F.col("doc_id").cast("long"), "text")

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part = encoder(vocabulary(name), True).encode, TaskContext.get().partitionId()
        seq, before, held, size, names = 0, 0, [], 0, []

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [seq], "before": [before], "n_docs": [len(names)], "n_tokens": [size], "body": [pack_segment(names, held)]})

        for batch in batches:
            ids = (None if pd.isna(x) else int(x) for x in batch["doc_id"].tolist())
            for doc_id, code in zip(ids, encode(batch["text"].tolist(), end), strict=True):
                names.append(doc_id)
                held.append(code)
                size += len(code) // 4
                if size >= SEGMENT_TOKENS:
                    yield flush()
                    seq, before, held, size, names = seq + 1, before + size, [], 0, []
        if names:
            yield flush()

    rows.mapInPandas(segments, SEGMENT).write.parquet(path)


def read_codes(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start and ids of every document (``digest``: n_tokens and ids_crc32 in place of ids), read from the files."""
    found = spark.read.schema(SEGMENT).parquet(path)
    # One row for each part, and parts are as many as shuffle partitions.
    sizes = sorted(found.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    first, total = {}, 0
    for part, n in sizes:
        first[part] = total
        total += n

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, before, body in zip(batch["part"], batch["before"], batch["body"], strict=True):
                names, ends, levels = open_segment(body)
                starts = np.concatenate([[0], ends[:-1]]).astype(int)
                ids = [tokens_between(levels, int(a), int(b)) for a, b in zip(starts, ends, strict=True)]
                out = pd.DataFrame({"doc_id": pd.array(names, "Int64"), "start": first[part] + before + starts})
                if digest:
                    yield out.assign(n_tokens=[len(x) for x in ids], ids_crc32=[zlib.crc32(x.astype("<u4").tobytes()) for x in ids])
                else:
                    yield out.assign(ids=[x.astype(np.int64) for x in ids])

    return found.select("part", "before", "body").mapInPandas(documents, "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids array<long>"))


def encode_and_read(docs: DataFrame) -> DataFrame:
    """Write the files to the shared folder and read every document back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-codes-{uuid.uuid4().hex}"
    write_codes(docs, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return read_codes(spark, path, digest=True)
