"""Best-fit packing of tokenized documents into sequences of at most 4096 tokens.

Each partition packs its pieces online: a piece goes to the open bin with the least free space that holds it. Open bins
are kept by free space, and a bitset over the free spaces gives the best fit by one shift. At most OPEN_BINS are open;
if another is needed, the fullest closes first. Bins that are still open at a partition's end are packed once more among
themselves as wholes, in groups of a bounded number of bins, so partitions leave no half-empty sequences behind.

Only documents of more than 4096 tokens are cut. A null or empty text is its end id alone. Repeated rows are packed each
(their pieces are alike), null ids are carried through, and an empty table gives no rows. Texts are encoded whole, however long.
``pieces`` ignores columns other than doc_id and text, whatever their names; ``pack`` keeps those of its input, which must not
be named bin, place, used, sequence_id or offset.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash
from tidemark.llm.tokens import encoder, vocabulary

VOCABULARY, END, LENGTH = "word_bpe_49k.json", 1, 4096
OPEN_BINS = 256
GROUP_BINS = 1 << 16  # open bins that one task packs again
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Online best-fit with at most ``most`` open bins; bins are named 0, 1, 2 in the order of opening."""

    def __init__(self, size: int = LENGTH, most: int = OPEN_BINS):
        self.size, self.most, self.opened, self.n_open = size, most, 0, 0
        self.free = 0  # bit f: an open bin has f tokens free
        self.bins: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        found = self.bins[free]
        out = found.pop()
        if not found:
            del self.bins[free]
            self.free ^= 1 << free
        self.n_open -= 1
        return out

    def put(self, length: int) -> tuple[int, int]:
        """Bin and place in it of a piece of 1 to ``size`` tokens."""
        if fits := self.free >> length:
            free = length + (fits & -fits).bit_length() - 1
            where = self._take(free)
        else:
            if self.n_open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            where, free, self.opened = self.opened, self.size, self.opened + 1
        if left := free - length:
            self.bins.setdefault(left, []).append(where)
            self.free |= 1 << left
            self.n_open += 1
        return where, self.size - free

    def still_open(self) -> list[tuple[int, int]]:
        """(bin, tokens used) of each open bin."""
        return [(b, self.size - free) for free, bins in sorted(self.bins.items()) for b in bins]


def pieces(docs: DataFrame, name: str = VOCABULARY, end: int = END, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """Pieces of every document, with their digest and (``ids``) their ids as little-endian unsigned 32-bit numbers."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary(name), False).encode
        for batch in batches:
            rows = []
            for doc_id, code in zip(batch["doc_id"].tolist(), encode(batch["text"].tolist(), end), strict=True):
                for k, at in enumerate(range(0, len(code), 4 * length)):
                    part = code[at : at + 4 * length]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] * ids)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECE + ", ids binary" * ids)


def pack(parts: DataFrame, size: int = LENGTH, most: int = OPEN_BINS) -> DataFrame:
    """``parts`` (with a column ``length``) with sequence_id and offset of each row."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit, base = BestFit(size, most), TaskContext.get().partitionId() << 32
        for batch in batches:
            put = [fit.put(int(n)) for n in batch["length"]]
            yield batch.assign(bin=[base + b for b, _ in put], place=[p for _, p in put], used=pd.array([None] * len(put), "Int64"))
        left = fit.still_open()
        # Rows with ``used`` are the bins that are still open.
        blank = batch.iloc[:0].reindex(range(len(left))) if left else None
        if left:
            yield blank.assign(bin=[base + b for b, _ in left], place=0, used=pd.array([u for _, u in left], "Int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    # Written once: what is packed and which bins are open must come from the same run of each task.
    placed = stash(parts.mapInPandas(place, f"{schema}, bin long, place long, used long"), "pack-placed")
    bins = placed.where("used IS NOT NULL").select("bin", "used")
    groups = max(1, math.ceil(bins.count() / GROUP_BINS))

    def again(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["used", "bin"], ascending=[False, True])
        fit, names, out = BestFit(size, len(group)), {}, []
        for name, used in zip(group["bin"], group["used"], strict=True):
            where, at = fit.put(int(used))
            out.append((name, names.setdefault(where, name), at))
        return pd.DataFrame(out, columns=["bin", "sequence_id", "base"])

    dealt = bins.withColumn("g", F.pmod(F.xxhash64("bin"), F.lit(groups)))
    merged = stash(dealt.groupBy("g").applyInPandas(again, "bin long, sequence_id long, base long"), "pack-merged")
    rows = placed.where("used IS NULL").drop("used").join(merged, "bin", "left")
    rows = rows.withColumn("sequence_id", F.coalesce("sequence_id", "bin")).withColumn("offset", F.col("place") + F.coalesce("base", F.lit(0)))
    return rows.drop("bin", "place", "base")
