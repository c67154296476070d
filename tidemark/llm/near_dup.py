"""Near-duplicate groups by HyperMinHash registers, banding and exact verification.

A document's set is its distinct ``shingle``-word shingles (lower case; with fewer words the whole sequence is one), kept
as 64-bit hashes. Its signature has one 16-bit register for each bucket of hashes: the leading zeros of the bucket's
least value and ten bits after its leading one. Empty registers
are filled from others before banding. Bands of registers are hashed; documents that share a band hash are
candidates. The number of registers in each of the BANDS bands is the largest for which a pair exactly at the threshold
is missed with a probability under MISS.

Copies are reduced to one document for each set first. Then candidates are linked without listing the pairs of a bucket:

1. Every member of a bucket is compared with the bucket's smallest id only: registers give a collision-corrected Jaccard
   estimate, and what could reach the threshold is compared by whole sets.
2. The links give components. Two members of a bucket that are still in different components may be linked all the same.
   The documents of such buckets are split by shingles: each is dealt by the rarest of its shingles, as many as two
   linked documents cannot all differ in, so documents that could be linked meet at one of them. Where few meet, those of
   different components and fitting sizes are compared; where many do, whole sets are compared inside tasks, in blocks of
   BLOCK documents: a document's overlaps with all others are counted at once, and what comes out is one link for each
   two components that it joins. A passage that very many documents share is a frequent shingle, so nobody meets there.

So every pair that shares a bucket is linked, refuted or inside one component: what banding finds is never lost, and no
step lists the pairs of a bucket. Components spread their smallest id along links, with pointer jumping.

Null texts and texts without words have the empty set, which is linked with nothing. Texts are taken whole, however long.
A null doc_id takes no part (component_id null, kept true). Rows of one doc_id are one document, that of the least text
which isn't null; all of them get its results. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free_shuffles, sorted_unique, stash, worker_cache

BANDS, MISS = 40, 1e-5
MANTISSA = 10  # bits of a register after its leading zeros
FILLS = 24  # rounds in which empty registers are filled before banding
BLOCK = 512  # members of a bucket that one task compares with as many others
MEMBERS = 64  # of one leader, compared by one run of sets
SALTS = 32  # over which the members of a leader with more than that are dealt
FEW = 64  # documents that meet at a shingle and are paired there
SLOTS = 1 << 20  # counters of frequent shingles
CHUNK = 1000  # documents whose sets a task holds at once
OFTEN = 6  # of them that hold a shingle from which on it is counted
U64 = np.uint64


def rows_for(percent: int) -> int:
    """Registers of each band for a threshold in percent."""
    return max(r for r in range(1, 17) if r == 1 or (1 - (percent / 100) ** r) ** BANDS <= MISS)


class _Hashes(dict):
    """64-bit hashes of words; frequent ones are remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 150_000:
            self[word] = value
        return value


def _hashes() -> _Hashes:
    return worker_cache("near_dup").setdefault("hashes", _Hashes())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text given as UTF-8."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and exactly the six white space bytes
    if not words:
        return np.zeros(0, U64)
    h = np.fromiter(map(_hashes().__getitem__, words), U64, len(words))
    n = min(shingle, len(words))
    acc = np.full(len(words) - n + 1, n, U64)
    for k in range(n):
        acc = _mix(acc * U64(0x9E3779B97F4A7C15) + h[k : len(words) - n + 1 + k])
    return sorted_unique(acc)


def registers(sets: list[np.ndarray], size: int) -> np.ndarray:
    """HyperMinHash registers (uint16, 0: empty) of each set, as rows."""
    least = np.full(len(sets) * size, ~U64(0), U64)
    if len(sets):
        h = np.concatenate(sets)
        bucket = ((h >> U64(32)) * U64(size)) >> U64(32)
        owner = np.repeat(np.arange(len(sets), dtype=U64) * U64(size), [len(s) for s in sets])
        np.minimum.at(least, (owner + bucket).astype(np.int64), _mix(h ^ U64(0x5851F42D4C957F2D)))
    zeros = (53 - np.frexp((least >> U64(11)).astype(np.float64))[1]).astype(U64)
    mantissa = (least << (zeros + U64(1))) >> U64(64 - MANTISSA)
    out = ((zeros + U64(1)) << U64(MANTISSA)) | mantissa
    return np.where(least == ~U64(0), U64(0), out).astype(np.uint16).reshape(len(sets), size)


def dense(regs: np.ndarray) -> np.ndarray:
    """Registers with every empty one filled from one that isn't, chosen by place alone; rows of empty ones stay.

    Else a band of a small set would be mostly empty, and one common shingle would decide it.
    """
    out, size = regs.copy(), regs.shape[1]
    rng = np.random.default_rng(size)
    for _ in range(FILLS):
        todo = (out == 0).any(axis=1)
        source = rng.permutation(size)
        if todo.any():
            out[todo] = np.where(out[todo] == 0, regs[todo][:, source], out[todo])
    todo = (out == 0).any(axis=1) & (regs > 0).any(axis=1)
    if todo.any():  # what is left takes the next register to its right, all around
        twice = np.concatenate([regs[todo], regs[todo]], axis=1)
        at = np.where(twice > 0, np.arange(2 * size), 2 * size)
        after = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :size]
        out[todo] = np.where(out[todo] == 0, np.take_along_axis(twice, after, axis=1), out[todo])
    return out


def band_keys(regs: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each row and band of filled registers, which differs between bands; 0 for empty sets."""
    r = dense(regs).reshape(len(regs), bands, -1)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), r.shape[:2]).copy()
    for k in range(r.shape[2]):
        acc = _mix(acc * U64(0x9E3779B97F4A7C15) + r[:, :, k].astype(U64))
    return np.where(r.any(axis=2), acc, U64(0)).view(np.int64)


def chance(na: np.ndarray, nb: np.ndarray, size: int) -> np.ndarray:
    """Probability that registers of two unrelated sets of these sizes agree."""
    i = np.arange(32)
    low, high = 1 - 2.0 ** -(i + 1), 1 - 2.0**-i
    p = lambda n: low ** (n[:, None] / size) - high ** (n[:, None] / size)  # noqa: E731  leading zeros of the least value
    return (np.abs(p(na)) * np.abs(p(nb))).sum(axis=1) * 2.0**-MANTISSA


def could_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the corrected estimate is within six standard deviations of the threshold, and the sizes allow it."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    by_chance = chance(na.astype(float), nb.astype(float), a.shape[1])
    estimate = (same / np.maximum(used, 1) - by_chance) / (1 - by_chance)
    t = percent / 100
    return (estimate >= t - 6 * np.sqrt(t * (1 - t) / np.maximum(used, 1))) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def signatures(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys and registers of each row."""
    rows = rows_for(percent)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                sets = [shingle_set(x, shingle) for x in part["text"]]
                regs = registers(sets, BANDS * rows)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None),
                        "n_shingles": [len(s) for s in sets],
                        "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                        "bands": [k[k != 0] for k in band_keys(regs, BANDS)],
                        "regs": [r.tobytes() for r in regs],
                    }
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInPandas(sign, "doc_id long, n_shingles long, digest binary, bands array<long>, regs binary")


def components(links: DataFrame) -> DataFrame:
    """node and its component's smallest node, for the nodes of ``links`` (u, v)."""
    both = stash(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "near-links")
    label = stash(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component")), "near-labels")
    while True:
        near = both.join(label.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        down = label.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        down = stash(down.join(jump, "component", "left").select("node", F.least("component", "further").alias("component"), "before"), "near-labels")
        if down.where("component < before").isEmpty():
            return down.select("node", "component")
        label = down.select("node", "component")


def _estimated(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose registers allow a link."""
    one = sigs.select(F.col("id").alias("u"), F.col("n_shingles").alias("nu"), F.col("regs").alias("ru"))
    two = sigs.select(F.col("id").alias("v"), F.col("n_shingles").alias("nv"), F.col("regs").alias("rv"))

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), -1) for c in ("ru", "rv"))
                yield batch.loc[could_reach(a, b, batch["nu"].to_numpy(), batch["nv"].to_numpy(), percent), ["u", "v"]]

    return pairs.join(one, "u").join(two, "v").mapInPandas(estimate, "u long, v long")


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) that whole sets confirm. A set goes once to each run of its partners, so no task holds many."""
    hot = pairs.groupBy("u").agg(F.ceil(F.count("*") / MEMBERS).alias("chunks")).where("chunks > 1")
    hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(hot, ["u", "salt"], "left")
    members = salted.select("u", F.pmod(F.xxhash64("v"), F.coalesce("chunks", F.lit(1))).alias("chunk"), F.col("v").alias("id"))
    # The leader comes first in its run: its id is smaller than those of the members.
    leaders = members.select("u", "chunk", F.col("u").alias("id")).distinct()
    wanted = members.union(leaders)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    rows = wanted.join(texts, "id").repartition("u", "chunk").sortWithinPartitions("u", "chunk", "id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, first = None, np.zeros(0, U64)
        for batch in batches:
            out = []
            for u, c, i, text in zip(batch["u"], batch["chunk"], batch["id"], batch["text"], strict=True):
                own = shingle_set(text, shingle)
                if (u, c) != run:
                    run, first = (u, c), own
                elif i != u:
                    both = len(np.intersect1d(first, own, assume_unique=True))
                    if 100 * both >= percent * (len(first) + len(own) - both):
                        out.append((u, i))
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return rows.mapInPandas(compare, "u long, v long")


class _Joined:
    """Components of the members of one run; starts from those known."""

    def __init__(self, labels: np.ndarray):
        self.of = np.unique(labels, return_inverse=True)[1]

    def join(self, a: int, others: np.ndarray) -> None:
        self.of[np.isin(self.of, self.of[others])] = self.of[a]


def links_among(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (places) that join all members of different components that are linked; exact, from whole sets.

    A member's overlaps with all others are counted at once, along the members that hold each of its shingles.
    """
    sizes = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(code, kind="stable")
    holders, ends = owner[order], np.cumsum(np.bincount(code))
    starts = np.concatenate([[0], ends[:-1]])
    first = np.concatenate([[0], np.cumsum(sizes)])
    joined, out = _Joined(labels), []
    for x in range(len(sets)):
        if (joined.of == joined.of[x]).all():
            continue
        own = code[first[x] : first[x + 1]]
        both = np.bincount(np.concatenate([holders[a:b] for a, b in zip(starts[own], ends[own], strict=True)]), minlength=len(sets))
        linked = np.flatnonzero((100 * both >= percent * (sizes + sizes[x] - both)) & (joined.of != joined.of[x]))
        if len(linked):
            linked = linked[np.unique(joined.of[linked], return_index=True)[1]]  # one link for each component
            out += [(x, int(y)) for y in linked]
            joined.join(x, linked)
    return out


def _frequencies(open_docs: DataFrame, shingle: int) -> np.ndarray:
    """How often shingles occur, by slots of their hashes; those that are rare in every chunk count as 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                h, n = np.unique(np.concatenate([shingle_set(x, shingle) for x in batch["text"].iloc[at : at + CHUNK]]), return_counts=True)
                often = n >= OFTEN
                yield pd.DataFrame({"slot": (h[often] % U64(SLOTS)).astype(np.int64), "n": n[often]})

    found = open_docs.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.int32)
    out[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**31 - 1)
    return out


def _dealt(open_docs: DataFrame, often: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """A row for each document and each shingle at which it meets those that it could be linked with."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), CHUNK):
                batch, first, n = whole.iloc[start : start + CHUNK], [], []
                for x in batch["text"]:  # any order that all documents share will do; the rarest come first, so few meet
                    h = shingle_set(x, shingle)
                    by = np.lexsort((h, often[(h % U64(SLOTS)).astype(np.int64)]))
                    first.append(h[by[: len(h) - (percent * len(h) + 99) // 100 + 1]].view(np.int64))
                    n.append(len(h))
                at = np.repeat(np.arange(len(n)), [len(x) for x in first])
                yield pd.DataFrame({"at": np.concatenate(first), "id": batch["id"].to_numpy()[at], "component": batch["component"].to_numpy()[at], "n": np.array(n, np.int64)[at]})

    return open_docs.select("id", "component", "text").mapInPandas(deal, "at long, id long, component long, n long")


def _among_blocks(met: DataFrame, open_docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (u, v) between different components of documents that meet (``met``: at, id, component) where many do.

    A large component has blocks of its own, and the documents of small ones share blocks. A pair of blocks is compared once,
    however often its members meet, and not at all if both are of one component.
    """
    # Small components lie with those that meet at the same shingle, the least of theirs, so few pairs of blocks come up.
    home = met.groupBy("id", "component").agg(F.min("at").alias("home"))
    own = home.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("component", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    home = home.join(own, "component", "left")
    shared = home.where("blocks IS NULL").groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("share"))
    place = lambda kind, of, n: F.struct(F.lit(kind).alias("kind"), F.col(of).alias("of"), F.pmod(F.xxhash64("id"), F.col(n)).alias("k"))
    block = F.when(F.col("blocks").isNotNull(), place(0, "component", "blocks")).otherwise(place(1, "home", "share"))
    placed = stash(home.join(shared, "home", "left").select("id", "component", block.alias("block")), "near-blocks")
    there = met.select("at", "id").join(placed, "id").groupBy("at").agg(F.sort_array(F.collect_set("block")).alias("all"))
    other = lambda x: F.filter("all", lambda y: y >= x)
    pairs = there.select(F.explode(F.flatten(F.transform("all", lambda x: F.transform(other(x), lambda y: F.struct(x.alias("i"), y.alias("j")))))).alias("p")).select("p.i", "p.j").distinct()
    pairs = pairs.where("NOT (i.kind = 0 AND j.kind = 0 AND i.of = j.of)")
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "held": [shingle_set(x, shingle).tobytes() for x in batch["text"]]})

    sets = open_docs.join(placed.select("id"), "id", "left_semi").select("id", "text").mapInPandas(shingles, "id long, held binary")
    rows = sides.join(placed, "block").join(sets, "id").select(F.xxhash64("i", "j").alias("pair"), "i", "j", "id", "component", "held")
    rows = rows.repartition("pair").sortWithinPartitions("pair", "i", "j", "id").select("pair", "i.kind", "i.of", "i.k", F.col("j.kind").alias("kind2"), F.col("j.of").alias("of2"), F.col("j.k").alias("k2"), "id", "component", "held")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, ids, labels, held = None, [], [], []

        def settle() -> list[tuple[int, int]]:
            if len(set(labels)) < 2:
                return []
            found = links_among([np.frombuffer(x, U64) for x in held], np.array(labels), percent)
            return [(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in found]

        for batch in batches:
            out = []
            for *pair, one, label, text in batch.itertuples(index=False):
                if pair != run:
                    out += settle()
                    run, ids, labels, held = pair, [], [], []
                ids.append(one)
                labels.append(label)
                held.append(text)
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")
        yield pd.DataFrame(settle(), columns=["u", "v"], dtype="int64")

    return rows.mapInPandas(compare, "u long, v long").distinct()


def _unsettled(members: DataFrame, docs: DataFrame, sigs: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """Links (u, v) between different components in one bucket. ``members``: key, id, component."""
    counts = members.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("z"), F.count("*").alias("n"))
    # The pairs of a bucket of two were compared already.
    some = members.join(counts.where("a < z AND n > 2").select("key"), "key").select("id", "component").distinct()
    open_docs = stash(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")).join(some, "id"), "near-open")
    if open_docs.isEmpty():
        return None
    dealt = stash(_dealt(open_docs, _frequencies(open_docs, shingle), shingle, percent), "near-dealt")
    free_shuffles(docs.sparkSession)
    groups = dealt.groupBy("at").agg(F.min("component").alias("a"), F.max("component").alias("z"), F.count("*").alias("there")).where("a < z").select("at", "there")
    met = stash(dealt.join(groups, "at"), "near-met")
    discard(dealt)
    # FEW documents at most in one list.
    few = met.where(F.col("there") <= FEW).groupBy("at").agg(F.collect_list(F.struct("id", "component", "n")).alias("all"))
    fits = lambda x, y: (x["id"] < y["id"]) & (x["component"] != y["component"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
    near = F.transform("all", lambda x: F.transform(F.filter("all", lambda y: fits(x, y)), lambda y: F.struct(x["id"].alias("u"), y["id"].alias("v"))))
    pairs = stash(_estimated(few.select(F.explode(F.flatten(near)).alias("p")).select("p.u", "p.v").distinct(), sigs, percent), "near-pairs")
    links = stash(_verified(pairs, open_docs.withColumnRenamed("id", "doc_id"), shingle, percent), "near-few")
    many = met.where(F.col("there") > FEW)
    if not many.isEmpty():
        links = stash(links.union(_among_blocks(many, open_docs, shingle, percent)), "near-many")
    discard(met, pairs)
    free_shuffles(docs.sparkSession)
    return links


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id) and kept (the component's smallest) of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        one = stash(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text")), "near-one-row")
        found = near_duplicates(one.union(docs.where("doc_id IS NULL")), shingle, percent)
        rows = docs.where("doc_id IS NOT NULL").select("doc_id").join(found, "doc_id")
        return rows.union(found.where("doc_id IS NULL")).select("doc_id", "n_shingles", "component_id", "kept")
    signed = stash(signatures(docs, shingle, percent), "near-signatures")
    # One document for each set; copies count through the partial aggregation only.
    classes = stash(signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id")), "near-classes")
    first = signed.where("digest IS NOT NULL").join(classes.withColumnRenamed("id", "doc_id"), ["doc_id", "digest"], "left_semi")
    sigs = first.select(F.col("doc_id").alias("id"), "n_shingles", "regs", "bands")
    keyed = stash(sigs.select("id", F.explode("bands").alias("key")), "near-keys")
    shared = keyed.groupBy("key").agg(F.min("id").alias("u"), F.max("id").alias("last")).where("u < last").select("key", "u")
    buckets = stash(keyed.join(shared, "key"), "near-buckets")
    discard(keyed)
    sigs = stash(sigs.select("id", "n_shingles", "regs").join(buckets.select("id").distinct(), "id", "left_semi"), "near-registers")
    free_shuffles(spark)
    stars = buckets.where("u < id").select("u", F.col("id").alias("v")).distinct()
    reps = docs.join(buckets.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    links = stash(_verified(stash(_estimated(stars, sigs, percent), "near-pairs"), reps, shingle, percent), "near-stars")
    free_shuffles(spark)
    label = components(links)
    members = buckets.select("key", "id").distinct().join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    more = _unsettled(members, reps, sigs, shingle, percent)
    if more is not None and not more.isEmpty():
        label = components(links.union(more))
    # Kept until the result is written; the large ones go now.
    out = signed.select("doc_id", "n_shingles", "digest")
    found = stash(classes.join(label.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component")), "near-found")
    discard(buckets, sigs, classes)
    free_shuffles(spark)
    out = out.join(found, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
