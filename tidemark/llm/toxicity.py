"""Toxicity by the nearest labelled examples: exact weighted TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of labelled training rows: at most EXAMPLES of each class, those with the least hash of
their ids; votes are weighted so that the classes count as in all labelled training rows. Terms are all words of the sample
and their beginnings (of 3 to 7 characters), however rare. What the labels tell of a term (chi-square) is a weight beside
its IDF and leaves no term out. Term frequencies are counted in whole texts, and document frequencies over all documents.

The index has the COMMON most frequent terms as columns, with the largest weight of each block of examples, and the postings
of all others. Terms that occur equally often in each of the examples are one term of the index. A search sums the others'
postings, bounds each block by its best sum and the query's weights times the block's largest ones, and leaves out the blocks
that cannot reach the k-th cosine; ties go to the smaller id. Of whole texts that leaves out few blocks, so batches of texts
multiply the columns for many at once, with the same result. Columns are multiplied in single precision, and all examples that
its largest error leaves in question are summed again in double precision, so the result is exact. The NEAREST neighbours
vote by squared cosine, together with a small prior, and are the evidence. The share of votes for label 1 becomes a probability by isotonic regression: every example is judged by the others, and the map from shares to
observed rates is fitted on those, so no held-out label is seen. A text that shares no term with an example gets the share of
label 1 among labelled training rows, or among those without words.

Null and empty texts have no terms; texts count whole, however long. A null doc_id is scored as any other (its text counts, its
id doesn't). Rows without a label are never examples; a repeated label row counts once, of contradicting ones label 1. Where a
labelled doc_id has several rows, the example is the row of the least text. With no labelled rows every score is 0. An empty
table gives no rows. Columns other than doc_id, text and toxic are ignored, whatever their names.
"""

from __future__ import annotations

import io
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, id_hash, stash

EXAMPLES = 2000  # of each class at most
COMMON = 1536  # terms that are columns of the index
BEGINNINGS = range(3, 8)
NEAREST, PRIOR_VOTES, BLOCK = 15, 0.02, 64
BATCH = 256  # texts whose columns are multiplied at once
KNOT = 0.02
STRIP = ".,;:!?\"'()[]{}<>|*#$%&"


def terms_of(word: str) -> set[str]:
    """A word and its beginnings, in lower case and without the marks around it; beginnings end in ``*``."""
    w = word.strip(STRIP).lower()
    return {w} | {w[:k] + "*" for k in BEGINNINGS if len(w) >= k} if w else set()


class Terms:
    """Looks up the last term of words: the word itself if it is a term, else its longest beginning.

    A term's beginnings are terms as well, so the last one stands for all (``above``).
    """

    def __init__(self, names: str):
        every = pa.array(names.split("\n") if names else [], pa.string())
        self.n, ids, starred = len(every), np.arange(len(every)), pc.ends_with(every, "*").to_numpy(zero_copy_only=False).astype(bool)  # no word ends so
        begin = pc.utf8_slice_codeunits(every.filter(pa.array(starred)), 0, -1)
        length = pc.utf8_length(begin).to_numpy()
        self.words = every.filter(pa.array(~starred)), ids[~starred]
        self.beginnings = {k: (begin.filter(pa.array(length == k)), ids[starred][length == k]) for k in BEGINNINGS}

    def _found(self, words: pa.Array, k: int | None = None) -> np.ndarray:
        """The number of each word, or of its beginning of ``k`` characters, and -1 for none."""
        names, ids = self.words if k is None else self.beginnings[k]
        at = pc.index_in(words if k is None else pc.utf8_slice_codeunits(words, 0, k), value_set=names)
        return np.append(ids, -1)[pc.fill_null(at, len(ids)).to_numpy()]

    def find(self, words: pa.Array) -> np.ndarray:
        """The last term of each word, and -1 for none."""
        words = pc.utf8_trim(words, characters=STRIP)
        plain = pc.string_is_ascii(words)
        other = pa.array([w.lower() for w in words.filter(pc.invert(plain)).to_numpy(zero_copy_only=False)], pa.string())
        words = pc.replace_with_mask(pc.ascii_lower(words), pc.invert(plain), other)
        found = self._found(words)
        for k in BEGINNINGS[::-1]:
            todo = np.flatnonzero(found < 0)
            found[todo] = self._found(words.take(pa.array(todo)), k)
        return found

    def last(self, texts: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
        """The last terms of each text's words in ascending order, and how often each occurs; a batch's distinct words are looked up once."""
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        found = self.find(coded.dictionary)[coded.indices.to_numpy()]
        row = np.repeat(np.arange(len(split)), split.value_lengths().to_numpy())
        key = np.sort((row * (self.n + 1) + found)[found >= 0])
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        counts, key = np.diff(np.append(first, len(key))), key[first]
        offsets = pa.array(np.searchsorted(key, np.arange(len(split) + 1) * (self.n + 1)).astype(np.int32))
        return tuple(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % (self.n + 1), counts))

    def above(self) -> np.ndarray:
        """A row for each term: itself and its beginnings, and then the number of terms for none."""
        out = np.full((self.n, len(BEGINNINGS) + 1), self.n, np.int32)
        for length, (names, ids) in ((None, self.words), *self.beginnings.items()):
            out[ids, 0] = ids
            for j, k in enumerate(BEGINNINGS, 1):
                if length is None or k < length:
                    found = self._found(names, k)
                    out[ids, j] = np.where(found < 0, self.n, found)
        return out


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sum of the values of each; keys and places are sorted as one number, which is faster than argsort."""
    bits, kind = len(keys).bit_length(), keys.dtype
    both = keys.astype(np.int64)
    both <<= bits
    both |= np.arange(len(keys))
    both.sort()
    keys = both >> bits
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first].astype(kind), np.add.reduceat(values[both & ((1 << bits) - 1)], first, dtype=values.dtype) if len(first) else values


def all_terms(above: np.ndarray, last: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a text in ascending order, and how often each occurs."""
    terms, n = summed(above[last].reshape(-1), np.repeat(counts, above.shape[1]))
    return (terms[:-1], n[:-1]) if len(terms) and terms[-1] == len(above) else (terms, n)


def _arrays(vector: dict[int, float] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of a vector."""
    return (np.fromiter(vector, int, len(vector)), np.fromiter(vector.values(), float, len(vector))) if isinstance(vector, dict) else vector


class BlockMaxIndex:
    """Unit vectors by term, in blocks of consecutive examples."""

    def __init__(self, vectors: Iterable, n_terms: int):
        pairs = [_arrays(v) for v in vectors]
        self.n, blocks = len(pairs), -(-len(pairs) // BLOCK)
        term = np.concatenate([np.zeros(0, np.int32), *[t for t, _ in pairs]], dtype=np.int32, casting="same_kind")
        weight = np.concatenate([np.zeros(0), *[w for _, w in pairs]])
        example = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in pairs])
        del pairs
        often = np.bincount(term, minlength=n_terms)
        common = np.argsort(-often, kind="stable")[:COMMON]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((blocks * BLOCK, len(common)), np.float32)
        c = self.column[term] >= 0
        rows, at, exact = example[c], self.column[term[c]], weight[c]
        term, example, weight = term[~c], example[~c], weight[~c]
        self.dense[rows, at] = exact
        self.most = np.zeros((len(common), blocks))
        np.maximum.at(self.most, (at, rows // BLOCK), exact)
        # The columns' weights as they are, by example.
        self.at, self.exact, self.rows = at.astype(np.min_scalar_type(COMMON)), exact, np.searchsorted(rows, np.arange(blocks * BLOCK + 1))
        # Where the postings of each other term start, and where the last ends.
        order = np.argsort(term, kind="stable")
        self.example, self.weight = example[order].astype(np.min_scalar_type(blocks * BLOCK)), weight[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])

    def nearest(self, query: dict[int, float] | tuple[np.ndarray, np.ndarray], k: int) -> tuple[list[tuple[float, int]], int]:
        """The ``k`` largest cosines above 0 as (cosine, example), and how many blocks were looked at."""
        terms, weights = _arrays(query)
        columns, scores = self._columns(terms, weights), self._others(terms, weights)
        bounds = scores.reshape(-1, BLOCK).max(1) + columns @ self.most
        order = np.argsort(-bounds, kind="stable")
        looked, least, found, near = 0, 0.0, np.zeros(len(scores)), self._error(columns)
        single = columns.astype(np.float32)
        while looked < len(order) and bounds[order[looked]] > 0 and bounds[order[looked]] >= least - near:
            b = slice(order[looked] * BLOCK, (order[looked] + 1) * BLOCK)
            found[b] = scores[b] + self.dense[b] @ single
            looked += 1
            if looked in (1, 4, 8) or looked % 16 == 0:  # the k-th of those seen so far
                least = max(0.0, float(np.partition(found, -k)[-k])) if len(found) >= k else 0.0
        return self._best(found, scores, columns, k), looked

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[list[tuple[float, int]]]:
        """What ``nearest`` finds for each query. Of whole texts bounds leave out few blocks, so the columns are multiplied for many queries at once."""
        for first in range(0, len(queries), BATCH):
            some = queries[first : first + BATCH]
            columns = np.stack([self._columns(*q) for q in some])
            products = columns.astype(np.float32) @ self.dense.T
            for q, own, row in zip(some, columns, products, strict=True):
                others = self._others(*q)
                yield self._best(row + others, others, own, k)

    def _columns(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        column = self.column[terms]
        dense = np.zeros(self.dense.shape[1])
        dense[column[column >= 0]] = weights[column >= 0]
        return dense

    def _others(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums over the terms that aren't columns, by example."""
        rare = self.column[terms] < 0
        terms, weights = terms[rare], weights[rare]
        starts = self.starts[terms]
        many = self.starts[terms + 1] - starts
        at = _runs(starts, many)
        products = self.weight.take(at)
        products *= np.repeat(weights, many)
        return np.bincount(self.example.take(at).astype(np.intp), products, len(self.dense))

    def _error(self, columns: np.ndarray) -> float:
        """More than twice what single precision may change of a product of the columns, as examples are unit vectors."""
        return 1e-9 + 2 * (len(columns) + 4) * 2.0**-24 * float(np.sqrt(columns @ columns))

    def _best(self, found: np.ndarray, others: np.ndarray, columns: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The ``k`` best examples, by exact cosines; ``found`` has those with the columns in single precision."""
        most, error = found.reshape(-1, BLOCK).max(1, initial=0), self._error(columns)
        # At least k examples are as near as the k-th of the blocks' best ones.
        least = float(np.partition(most, -k)[-k]) if len(most) >= k else 0.0
        best = np.flatnonzero(found >= max(least - error, 1e-300))
        if len(best) > k:
            near = found[best]
            best = best[near >= np.partition(near, -k)[-k] - error]
        if not len(best):
            return []
        many = self.rows[best + 1] - self.rows[best]
        at = _runs(self.rows[best], many)
        exact = others[best] + np.bincount(np.repeat(np.arange(len(best)), many), self.exact[at] * columns[self.at[at]], len(best))
        order = np.lexsort((best, -np.round(exact, 9)))[:k]
        return [x for x in zip(exact[order].tolist(), best[order].tolist(), strict=True) if x[0] > 0]


def _runs(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places of runs, one after the other."""
    ends = np.cumsum(many)
    at = np.repeat(starts - ends + many, many)
    at += np.arange(len(at), dtype=at.dtype)
    return at


def _unit(counted: tuple[np.ndarray, np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms, counts = counted
    raw = (1 + np.log(counts)) * weight[terms]
    return terms, raw / np.sqrt(raw @ raw) if len(raw) else raw


def alike(counted: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> np.ndarray:
    """A number for each term, the same for terms that occur equally often in each of the examples (a word and a beginning of it alone).

    A term, an example and a count are sorted as one number of 63 bits, which some thousand examples leave room for.
    """
    at, many = (max(1, int(x).bit_length()) for x in (len(counted), max((n.max(initial=0) for _, n in counted), default=0)))
    if n_terms.bit_length() + at + many > 63:
        raise ValueError("terms, examples and counts don't fit one number")
    postings = np.empty(sum(len(t) for t, _ in counted), np.int64)
    end = 0
    for example, (t, n) in enumerate(counted):
        some = postings[end : (end := end + len(t))]
        some[:] = t
        some <<= at
        some |= example
        some <<= many
        some |= n
    postings.sort()
    ends = np.searchsorted(postings, np.arange(1, n_terms + 1) << (at + many)).tolist()
    postings &= (1 << (at + many)) - 1
    postings = postings.astype(np.min_scalar_type((1 << (at + many)) - 1))
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(postings[a:b].tobytes(), len(seen)) for a, b in zip([0, *ends], ends)], np.int32)


def _taken(items: list, order: list[int]) -> Iterator:
    """Items in ``order``, which the list no longer holds then."""
    for i in order:
        item, items[i] = items[i], None
        yield item


class Merge:
    """Vectors by term become vectors by group of terms that are ``alike``; cosines with examples stay as they are.

    In an example a group's terms weigh in proportion to their weights, so one number stands for them.
    """

    def __init__(self, group: np.ndarray, weight: np.ndarray):
        self.group, self.n = group, int(group.max(initial=-1)) + 1
        self.share = weight / np.sqrt(np.bincount(group, weight * weight, self.n))[group]

    def __call__(self, vector: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        terms, weights = vector
        return summed(self.group[terms], weights * self.share[terms])


class Search:
    """The index, and what makes queries of counted texts; compressed where it is sent and stored."""

    def __init__(self, index: BlockMaxIndex, above: np.ndarray, weight: np.ndarray, merge: Merge):
        self.index, self.above, self.weight, self.merge = index, above, weight, merge

    def nearest(self, batch: pd.DataFrame, k: int) -> Iterator[list[tuple[float, int]]]:
        """The ``k`` nearest examples of each row by its last terms and their counts."""
        for at in range(0, len(batch), BATCH):
            some = batch.iloc[at : at + BATCH]
            yield from self.index.nearest_of([self.merge(_unit(all_terms(self.above, t, n), self.weight)) for t, n in zip(some["terms"], some["counts"], strict=True)], k)

    def __getstate__(self) -> bytes:
        """Written array by array: the whole is never beside its bytes."""
        out = io.BytesIO()
        with zstandard.ZstdCompressor(level=3).stream_writer(out, closefd=False) as to:
            pickle.dump(self.__dict__, to, protocol=5)
        return out.getvalue()

    def __setstate__(self, state: bytes) -> None:
        with zstandard.ZstdDecompressor().stream_reader(state) as of:
            self.__dict__.update(pickle.load(of))


def examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic and rows (labelled training rows that the example stands for)."""
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = marked.where(F.pmod(id_hash(F.col("doc_id")), F.lit(4)) != 2)
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id", F.lit("example"))
    picked = [train.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(EXAMPLES).withColumn("rows", F.lit(sizes.get(y, 0) / max(1, min(EXAMPLES, sizes.get(y, 0))))) for y in (0, 1)]
    # At most 2 x EXAMPLES slim rows.
    return docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("rows").alias("rows"))


def weighted_terms(sample: DataFrame) -> tuple[str, np.ndarray]:
    """All terms of the sample (a line each) with their weights by the labels, most telling of label 1 first; ties by the term.

    The weight is 1, and more by chi-square if the term goes with label 1.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: Counter = Counter()
            for text, y in zip(batch["text"], batch["toxic"], strict=True):
                n.update((t, int(y)) for t in set().union(*map(terms_of, set((text or "").split()))))
            yield pd.DataFrame([(t, y, c) for (t, y), c in n.items()], columns=["term", "toxic", "n"])

    classes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    p, q = classes.get(1, 0), classes.get(0, 0)
    by = sample.select("text", "toxic").mapInPandas(spread, "term string, toxic int, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).cast("double").alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).cast("double").alias("b"))
    a, b, n = F.col("a"), F.col("b"), float(p + q)
    chi2 = n * (a * (q - b) - b * (p - a)) ** 2 / ((a + b) * (n - a - b) * p * q)
    telling = (a * q > b * p) & (a + b < n)
    found = by.select("term", F.when(telling, 1 + chi2).otherwise(1.0).alias("weight")).toArrow()  # the terms of a bounded sample
    found = found.sort_by([("weight", "descending"), ("term", "ascending")])
    return "\n".join(found["term"].to_pylist()), found["weight"].to_numpy().astype(float)


COUNTED = "terms array<int>, counts array<int>"


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and evidence (doc_ids of the neighbours, nearest first) of each row."""
    sample = stash(examples(docs, labels), "toxic-examples")
    names, label_weight = weighted_terms(sample)
    above, n_terms = Terms(names).above(), len(label_weight)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(names)
        for batch in batches:
            last, n = terms.last(batch["text"])
            kept = batch.drop_columns("text")
            yield pa.RecordBatch.from_arrays([*kept.columns, last, n], [*kept.schema.names, "terms", "counts"])

    counted = stash(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, f"doc_id long, {COUNTED}"), "toxic-terms")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Documents with each term, and all documents."""
        n, rows = np.zeros(n_terms + 1), 0
        for batch in batches:
            for t in batch["terms"]:
                n[above[t].reshape(-1)] += 1  # once for each term, however often it is named
            rows += len(batch)
        n[-1] = rows
        yield pd.DataFrame({"values": [n]})

    found_in = sum_arrays(counted.select("terms").mapInPandas(frequencies, SUMMED), n_terms + 1)
    weight = label_weight * (np.log((found_in[-1] + 1.0) / (found_in[:-1] + 1.0)) + 1)
    sample_terms = stash(sample.select("doc_id", "toxic", "rows", "text").mapInArrow(count, f"doc_id long, toxic int, rows double, {COUNTED}"), "toxic-example-terms")
    found = sample_terms.toArrow().sort_by("doc_id")
    ids, toxic, stands = (found[c].to_numpy() for c in ("doc_id", "toxic", "rows"))
    whole = [all_terms(above, np.array(t.values, np.int32), np.array(n.values, np.int32)) for t, n in zip(found["terms"], found["counts"], strict=True)]
    del found
    merge = Merge(alike(whole, n_terms), weight)
    vectors = whole
    for i, x in enumerate(whole):  # in place, so that the driver holds no example twice
        vectors[i] = merge(_unit(x, weight))
    blank = np.array([not len(t) for t, _ in vectors], bool)
    base = (float(stands @ toxic) + 0.5) / (float(stands.sum()) + 1) if len(ids) else 0.0
    base = (float(stands[blank] @ toxic[blank]) + base) / (float(stands[blank].sum()) + 1)
    # Similar examples next to each other make tight bounds.
    order = sorted(np.flatnonzero(~blank).tolist(), key=lambda i: (vectors[i][0][0], ids[i]))
    index = BlockMaxIndex(_taken(vectors, order), merge.n)
    ids, toxic, stands = ids[order], toxic[order].astype(float), stands[order]
    scale = stands.mean() if len(stands) else 1.0
    # One copy on each machine for both searches: a function's own variables would be sent, and written to disk, with each function.
    shared = docs.sparkSession.sparkContext.broadcast(Search(index, above, weight, merge))
    del index, above, weight, merge

    def share_of(near: list[tuple[float, int]]) -> float:
        at = [e for _, e in near]
        votes = np.array([s * s for s, _ in near]) * stands[at] / scale if near else np.zeros(0)
        return float((votes @ toxic[at] + PRIOR_VOTES * base) / (votes.sum() + PRIOR_VOTES)) if near else base

    def by_others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Shares of the examples, each without its own vote."""
        place = {int(x): i for i, x in enumerate(ids)}
        for batch in batches:
            batch = batch[batch["doc_id"].isin(place)]
            near = shared.value.nearest(batch, NEAREST + 1)
            rows = [(int(doc_id), share_of([x for x in found if x[1] != place[int(doc_id)]][:NEAREST])) for doc_id, found in zip(batch["doc_id"], near, strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "share"]).astype({"doc_id": "int64", "share": float})

    # Counted before: a function on top of another's rows takes a second Python worker for each task, and workers keep the index.
    judged = sample_terms.select("doc_id", "terms", "counts").repartition(16).mapInPandas(by_others, "doc_id long, share double").toArrow().sort_by("doc_id")
    discard(sample_terms)
    at = {int(x): i for i, x in enumerate(ids)}
    own = [at[x] for x in judged["doc_id"].to_pylist()]
    knots = isotonic(judged["share"].to_numpy(), toxic[own], stands[own])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores, evidence = [], []
            for near in shared.value.nearest(batch, NEAREST):
                scores.append(float(np.interp(share_of(near), *knots)) if near and len(knots[0]) else base)
                evidence.append([int(ids[e]) for _, e in near])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": scores, "evidence": evidence})

    return counted.mapInPandas(judge, "doc_id long, score double, evidence array<long>")


def isotonic(shares: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (share, rate) of the best rising map from shares to labels, weighted by ``rows``: neighbours that fall are pooled.

    Shares are taken in steps of KNOT, and each pool has half a row of each label besides its own, so no rate is 0 or 1.
    """
    step = np.round(shares / KNOT).astype(int)
    pools: list[list[float]] = []  # weight, weight of label 1, weighted share
    for k in np.unique(step):
        i = step == k
        pools.append([rows[i].sum(), rows[i] @ labels[i], rows[i] @ shares[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([s / n for n, _, s in pools]), np.array([(y + 0.5) / (n + 1) for n, y, _ in pools])


SUMMED = "values array<double>"


def sum_arrays(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of the arrays of ``size`` in column ``values``: some tasks add theirs, and the driver adds those."""

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch["values"]:
                total += v
        yield pd.DataFrame({"values": [total]})

    return sum((np.array(r["values"]) for r in rows.repartition(8).mapInPandas(added, SUMMED).toLocalIterator()), np.zeros(size))
