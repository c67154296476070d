"""Exact top-k by integer inner product, searched best first in a paged M-tree.

The largest inner product is a nearest neighbour after one more coordinate: with M the largest squared norm, a vector v
becomes (v, sqrt(M - v.v)) and a query q becomes (q, 0), so the squared distance is q.q + M - 2 q.v. In that metric the
tree's nodes have a centre and a covering radius, and every node and entry keeps its distance from its parent's centre.

Build: a node with more than SUBTREE vectors is divided among pivots drawn from its own vectors by a hash of the ids (FANOUT
at most), each vector going to the nearest; so the tree gains levels as the data grows, and every node keeps its centre, its
covering radius and its distance from its parent's centre. The levels are tables, and vectors meet the pivots of their node
in tasks of bounded size, so no level of the tree goes through the driver. A node whose pivots are all alike (very many copies
of one vector) is dealt into runs of SUBTREE vectors as it is. The last level's vectors lie in pages of up to PAGE vectors.

Search: a query first goes down to its nearest leaf, which gives a score that its k-th result must reach. Then it goes down
to every node that could hold such a score: a child is passed by where its stored distance from the parent settles that, else
its own distance decides. In a leaf, pages are skipped by their stored distance from the leaf's centre alone where that settles
it; the others are visited in the order of their bound until no bound reaches the k-th score; in a page, entries are skipped by
their stored distances. Bounds have a margin for rounding, and scores are exact integers, so the results are those of brute
force; ties go to the smaller id.

Vectors that are null, or hold a null or a component that isn't finite, take no part, nor do null ids, nor vectors whose squared
length is 2^62 or more after scaling, as their scores may not fit a long. Shorter vectors count as padded with zeros. Rows of
one id are each a candidate, but one of them (the least vector) is the query, and none is a candidate for its own id. An empty
table gives no rows. Columns other than the two are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash

SCALE = 256
FANOUT, SUBTREE, PAGE = 64, 8192, 64
RUN = 1 << 16  # vectors that meet the pivots of their node in one task
QUERY_BLOCK = 1 << 15  # queries that meet a node or a leaf at once
LARGE = 2.0**51  # squared length from which scores are summed as whole numbers
NODE = "parent long, child long, centre binary, to_parent double"
PAGES = "leaf long, salt int, middle binary, centre binary, radius double, to_pivot double, ids array<long>, vectors binary, to_centre binary"


def quantized(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and v (array of floor(256 * x)) of the vectors that take part."""
    fine = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * SCALE))
    small = F.aggregate(column, F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") * SCALE, 2.0)) < 2.0**61  # floor adds less than that much again
    return vectors.where(F.col(column).isNotNull() & F.col(key).isNotNull()).where(fine).where(small).select(F.col(key).cast("long").alias("id"), scaled.alias("v"))


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _lift(v: np.ndarray, most: float) -> np.ndarray:
    """The vectors with their last coordinate."""
    return np.hstack([v, np.sqrt(np.maximum(0, most - (v * v).sum(axis=1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


def make_pages(ids: np.ndarray, vectors: np.ndarray, pivot: np.ndarray, most: float) -> list[tuple]:
    """Pages of a subtree: (centre, radius, distance from the pivot, ids, vectors, distances from the centre)."""
    lifted = _lift(vectors, most)
    centres = lifted[np.linspace(0, len(ids) - 1, -(-len(ids) // PAGE)).astype(int)]
    d = _distances(lifted, centres)
    nearest = d.argmin(axis=1)
    out = []
    for c in np.unique(nearest):
        rows = np.flatnonzero(nearest == c)
        rows = rows[np.argsort(d[rows, c], kind="stable")]
        for at in range(0, len(rows), PAGE):
            r = rows[at : at + PAGE]
            out.append((centres[c], float(d[r, c].max()), float(np.sqrt(((centres[c] - pivot) ** 2).sum())), ids[r], vectors[r], d[r, c]))
    return out


class Subtree:
    """The pages under one pivot, with counts of what a search has computed."""

    def __init__(self, pages: list[tuple], pivot: np.ndarray, most: float):
        self.centres = np.array([p[0] for p in pages])
        self.radius = np.array([p[1] for p in pages])
        self.to_pivot = np.array([p[2] for p in pages])
        self.pages, self.pivot, self.most = pages, pivot, most
        self.margin = 0.5 + 1e-9 * most  # scores are whole numbers
        self.computed = 0

    def search(self, qid: int, q: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """Up to ``k`` (score, id) with scores of at least ``least``, best first."""
        qq, lifted = float(q @ q), np.append(q, 0.0)
        reach = lambda d: (qq + self.most - d * d) / 2  # noqa: E731  the score at a distance
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        floor = least
        to_pivot = math.sqrt(max(0.0, ((lifted - self.pivot) ** 2).sum()))
        near = np.maximum(0, np.abs(to_pivot - self.to_pivot) - self.radius)
        alive = np.flatnonzero(reach(near) >= floor - self.margin)
        d = np.sqrt(np.maximum(0, qq + (self.centres[alive] ** 2).sum(axis=1) - 2 * self.centres[alive] @ lifted))
        bound = reach(np.maximum(0, d - self.radius[alive]))
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < floor - self.margin:
                break
            _, _, _, ids, vectors, to_centre = self.pages[alive[i]]
            keep = np.flatnonzero(reach(np.abs(d[i] - to_centre)) >= floor - self.margin)
            self.computed += len(keep)
            scores = vectors[keep] @ q if self.most < LARGE else (vectors[keep].astype(np.int64) * q.astype(np.int64)).sum(axis=1)
            for j in np.flatnonzero(scores >= floor):
                if ids[keep[j]] != qid:
                    entry = (int(scores[j]), -int(ids[keep[j]]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    else:
                        heapq.heappushpop(best, entry)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, float).tobytes()


def build(data: DataFrame, n: int, dims: int, most: float) -> tuple[DataFrame, list[DataFrame]]:
    """The vectors with leaf, salts and middle (its leaf's centre), and the levels: parent, child, centre, to_parent, radius,
    salts (0: not a leaf). ``data``: id and v. The root is node 0, without a centre."""
    placed = data.withColumn("node", F.lit(0).cast("long")).withColumn("middle", F.lit(None).cast("binary")).withColumn("away", F.lit(0.0))
    sizes = placed.sparkSession.range(1).select(F.col("id").alias("node"), F.lit(n).cast("long").alias("n"))
    levels, leaves, first = [], None, True
    while True:
        # Pivots of the nodes that are too large, a few dozen for each.
        large = sizes.where(F.col("n") > (0 if first else SUBTREE)).withColumn("every", F.ceil(F.col("n") / F.least(F.lit(FANOUT), F.greatest(F.lit(8), F.ceil(F.col("n") / SUBTREE)))))
        drawn = placed.join(large, "node").where(F.pmod(F.xxhash64("id", "node"), F.col("every")) == 0).select("node", "n", "v", "middle").dropDuplicates(["node", "v"])
        drawn = drawn.withColumn("child", F.xxhash64("node", "v"))
        several = drawn.groupBy("node").agg(F.count("*").alias("pivots"), F.first("n").alias("n")).where(F.col("pivots") > (0 if first else 1))
        pivots = stash(drawn.join(several.select("node"), "node").select("node", "child", "v", "middle", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / RUN) - 1)).alias("run")), "tree-pivots")
        split = stash(several.select("node", F.ceil(F.col("n") / RUN).alias("runs")), "tree-split")
        if first and split.isEmpty():  # no vector was drawn: the root is one leaf about its least vector
            one = data.orderBy("id").limit(1).select(F.lit(0).cast("long").alias("node"), F.lit(1).cast("long").alias("child"), "v", F.lit(None).cast("binary").alias("middle"), F.explode(F.sequence(F.lit(0), F.lit(-(-n // RUN) - 1))).cast("long").alias("run"))
            pivots, split = stash(one, "tree-pivots"), stash(data.sparkSession.range(1).select(F.col("id").alias("node"), F.lit(-(-n // RUN)).cast("long").alias("runs")), "tree-split")
        if not first:
            done = placed.join(split, "node", "left_anti").join(sizes, "node")
            done = done.select("id", "v", F.col("node").alias("leaf"), F.ceil(F.col("n") / SUBTREE).cast("int").alias("salts"), "middle")
            leaves = done if leaves is None else leaves.union(done)
            final = sizes.join(split, "node", "left_anti").select(F.col("node").alias("child"), F.ceil(F.col("n") / SUBTREE).cast("int").alias("salts"))
            levels[-1] = stash(levels[-1].join(final, "child", "left").withColumn("salts", F.coalesce("salts", F.lit(0))), "tree-level")
        if split.isEmpty():
            return leaves, levels

        def divide(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(pivots):
                return pd.DataFrame([], columns=["id", "v", "node", "middle", "away"])
            pivots = pivots.sort_values("child")
            centres = _lift(_matrix(pivots["v"], dims), most)
            d = _distances(_lift(_matrix(rows["v"], dims), most), centres)
            at = d.argmin(axis=1)
            held = [_bytes(c) for c in centres]
            return pd.DataFrame({"id": rows["id"], "v": rows["v"], "node": pivots["child"].to_numpy()[at], "middle": [held[i] for i in at], "away": d.min(axis=1)})

        def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                centres = _lift(_matrix(batch["v"], dims), most)
                above = [0.0 if m is None else float(np.sqrt(((np.frombuffer(m, float) - c) ** 2).sum())) for m, c in zip(batch["middle"], centres, strict=True)]
                yield pd.DataFrame({"parent": batch["node"], "child": batch["child"], "centre": [_bytes(c) for c in centres], "to_parent": above})

        dealt = placed.join(split, "node").withColumn("run", F.pmod(F.xxhash64("id", F.lit("run")), F.col("runs"))).select("id", "v", "node", "run")
        placed = stash(dealt.groupBy("node", "run").cogroup(pivots.groupBy("node", "run")).applyInPandas(divide, "id long, v array<long>, node long, middle binary, away double"), "tree-placed")
        found = stash(placed.groupBy("node").agg(F.count("*").alias("n"), F.max("away").alias("radius")), "tree-sizes")
        nodes = pivots.where("run = 0").select("node", "child", "v", "middle").mapInPandas(describe, NODE)
        # A radius is widened by what rounding may cost.
        levels.append(nodes.join(found.select(F.col("node").alias("child"), (F.col("radius") * (1 + 1e-9)).alias("radius")), "child"))
        sizes, first = found.select("node", "n"), False


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best candidates of each query. Both: id and v, as ``quantized`` gives."""
    spark = vectors.sparkSession
    data = stash(vectors, "tree-vectors")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    n, dims, most = data.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    # A query that is longer than all vectors widens the space too.
    asked = stash(queries.groupBy("id").agg(F.min("v").alias("v")), "tree-queries")
    dims = max(dims or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    most = float(most or 0)
    schema = "query_id long, rank int, vec_id long, score long"
    n_queries = asked.count()
    if not n or not n_queries:
        return spark.createDataFrame([], schema)
    leaves, levels = build(data, n, dims, most)
    back = lambda x: np.frombuffer(x, float)
    # A repeated id is dealt by its vector too.
    dealt = leaves.withColumn("salt", F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.col("salts")).cast("int"))

    def paginate(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        middle = group["middle"].iloc[0]
        pivot, v = back(middle), _matrix(group["v"], dims)
        order = np.argsort(_distances(_lift(v, most), pivot[None])[:, 0], kind="stable")
        made = make_pages(group["id"].to_numpy()[order], v[order], pivot, most)
        leaf, salt = int(group["leaf"].iloc[0]), int(group["salt"].iloc[0])
        return pd.DataFrame([(leaf, salt, middle, c.tobytes(), r, t, i, v.tobytes(), d.tobytes()) for c, r, t, i, v, d in made], columns=["leaf", "salt", "middle", "centre", "radius", "to_pivot", "ids", "vectors", "to_centre"])

    pages = stash(dealt.select("id", "v", "leaf", "salt", "middle").groupBy("leaf", "salt").applyInPandas(paginate, PAGES), "tree-pages")
    blocks = math.ceil(n_queries / QUERY_BLOCK)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def look(queries: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(nodes):
            tree = Subtree([(back(c), r, t, np.asarray(i), back(v).reshape(-1, dims), back(d)) for c, r, t, i, v, d in nodes[["centre", "radius", "to_pivot", "ids", "vectors", "to_centre"]].itertuples(index=False)], back(nodes["middle"].iloc[0]), most)
            for qid, q, least in zip(queries["id"], _matrix(queries["v"], dims), queries["least"], strict=True):
                out += [(qid, i, s) for s, i in tree.search(qid, q, k, least)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    # Each query block meets a copy of the pages; blocks are large, so copies are few.
    paged = pages.select("*", every)
    searched = lambda routes: routes.groupBy("leaf", "salt", "block").cogroup(paged.groupBy("leaf", "salt", "block")).applyInPandas(look, "query_id long, vec_id long, score long")
    ROUTE = "id long, v array<long>, block int, least double, node long, above double, salts int"

    def down(nearest: bool):
        def run(queries: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(queries) and len(nodes):
                nodes = nodes.sort_values("child")
                centres, child, salts = np.array([back(c) for c in nodes["centre"]]), nodes["child"].to_numpy(), nodes["salts"].to_numpy()
                radius, to_parent = nodes["radius"].to_numpy(), nodes["to_parent"].to_numpy()
                for qid, v, b, least, above in zip(queries["id"], queries["v"], queries["block"], queries["least"], queries["above"], strict=True):
                    q = np.zeros(dims + 1)
                    q[: len(v)] = v
                    reach = lambda d: (q @ q + most - np.maximum(0, d) ** 2) / 2  # noqa: E731, B023
                    margin = 0.5 + 1e-9 * most
                    # The root (above < 0) has no centre to go by.
                    open_ = np.arange(len(child)) if nearest or above < 0 else np.flatnonzero(reach(np.abs(above - to_parent) - radius) >= least - margin)
                    d = _distances(q[None], centres[open_])[0]
                    chosen = [int(d.argmin())] if nearest else np.flatnonzero(reach(d - radius[open_]) >= least - margin)
                    out += [(qid, v, b, least, child[open_[i]], float(d[i]), salts[open_[i]]) for i in chosen]
            return pd.DataFrame(out, columns=["id", "v", "block", "least", "node", "above", "salts"])

        return run

    def routes(start: DataFrame, nearest: bool) -> DataFrame:
        """The leaves that each query goes to."""
        at, out = start.withColumn("node", F.lit(0).cast("long")).withColumn("above", F.lit(-1.0)).withColumn("salts", F.lit(0)), None
        for level in levels:
            copies = level.select("*", every).groupBy(F.col("parent"), F.col("block"))
            at = at.where("salts = 0").groupBy("node", "block").cogroup(copies).applyInPandas(down(nearest), ROUTE)
            at = stash(at, "tree-routes") if len(levels) > 1 else at
            out = at.where("salts > 0") if out is None else out.union(at.where("salts > 0"))
        return out

    unknown = F.lit(float("-inf")).alias("least")
    own = F.pmod(F.col("id"), F.col("salts")).cast("int")
    homes = stash(routes(asked.select("id", "v", block, unknown), True).withColumn("salt", own), "tree-homes")
    home = stash(searched(homes.select("id", "v", "block", "least", F.col("node").alias("leaf"), "salt")), "tree-home")
    reached = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low"))
    least = F.when(F.col("n") >= k, F.col("low")).otherwise(float("-inf")).alias("least")
    further = routes(asked.join(reached, F.col("id") == F.col("query_id"), "left").select("id", "v", block, least), False)
    further = further.select("id", "v", "block", "least", F.col("node").alias("leaf"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    further = further.join(homes.select("id", F.col("node").alias("leaf"), "salt"), ["id", "leaf", "salt"], "left_anti").select("id", "v", "block", "least", "leaf", "salt")
    found = home.union(searched(further))
    ranked = found.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
