"""Quality by supervised subword embeddings: the mean of learned word and character n-gram vectors, and a softmax over it.

A word gives its own feature and the character n-grams (GRAMS) of the word between ``<`` and ``>``; each is hashed to one
of BUCKETS vectors of DIM numbers. A word that repeats the one before it gives the features of the word AGAIN as well. A document is the mean of its features' vectors, counted as often as they occur, in its whole
text; a linear layer and a softmax give the probability of label 1. Vectors and layer are learned by stochastic gradient descent
in numpy (minibatches, step sizes by AdaGrad) in one task on a bounded sample of labelled training rows: at most FIT of each
label, those with the least hash of their ids, weighted so that the labels count as in all labelled training rows. A sample
row keeps at most BUCKETS counts, so what the task holds is bounded however long texts are. A tenth of the sample isn't trained
on: it tells which epoch was best, and the temperature and shift of the scores are fitted on it, so scores are calibrated.

The layer is linear in the mean, so a word adds a fixed amount to a document's odds: scoring looks up an amount and a number
of features for each word. Texts without words get the share of label 1 among such sample rows, drawn to that of all.
Case and the marks on words count, as they tell junk from prose.

Null and empty texts have no words. A null doc_id is scored as any other. Rows without a label don't teach; of a
repeated label the larger counts; where a labelled doc_id has several rows the row of the least text teaches. Without labelled rows
every score is 0.5. Equal texts score alike. An empty table gives no rows. Columns other than doc_id, text and quality are
ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_hash, stash, worker_cache

FIT = 3000  # rows of each label at most
BUCKETS, DIM, GRAMS = 1 << 14, 8, (1, 2, 3, 4)
EPOCHS, BATCH, RATE = 12, 32, 0.5
KEPT_WORDS = 300_000
SLICE_WORDS, SLICE_LETTERS = 4096, 1 << 20  # looked at together
MULTIPLIER = 0x9E3779B1  # of the hash of n-grams: odd, near the golden ratio of 2^32
AGAIN = "= ="  # no word, as words have no blanks


def counted_words(text: str | None) -> Counter:
    """A text's words, and AGAIN for each word that is the same as the one before it."""
    words = (text or "").split()
    n = Counter(words)
    if again := sum(map(str.__eq__, words, words[1:])):
        n[AGAIN] = again
    return n


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all words as (place of the word, bucket): the word itself, and its character n-grams."""
    letters = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word, left = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size) - np.arange(len(letters))
    places, hashes = [np.arange(len(words))], [np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words))]
    h = np.zeros(len(letters), np.uint32)
    for k in range(1, max(GRAMS) + 1):
        h = (h[: max(0, len(letters) - k + 1)] ^ letters[k - 1 :]) * np.uint32(MULTIPLIER)
        if k in GRAMS:
            whole = left[: len(h)] >= k
            places.append(word[: len(h)][whole])
            hashes.append(h[whole] ^ h[whole] >> np.uint32(15))
    return np.concatenate(places), (np.concatenate(hashes) % np.uint32(BUCKETS)).astype(np.int64)


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's features in ascending order with how often each occurs."""
    words = counted_words(text)
    place, bucket = features_of(list(words))
    n = np.bincount(bucket, np.fromiter(words.values(), float, len(words))[place], BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


class Amounts:
    """What each word adds to the log odds in all, and the number of its features, filled as words come up."""

    def __init__(self, amount: np.ndarray):
        self.amount, self.ids, self.of, self.many = amount, {}, np.zeros(0), np.zeros(0)

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: what its words add, and the number of features."""
        counted = [counted_words(t) for t in texts]
        if len(self.ids) > KEPT_WORDS:
            self.ids, self.of, self.many = {}, np.zeros(0), np.zeros(0)
        new = list(dict.fromkeys(w for words in counted for w in words if w not in self.ids))
        if new:
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            # Every word has a feature, so the sums of a slice have a place for each of its words.
            found = [features_of(new[k : k + SLICE_WORDS]) for k in range(0, len(new), SLICE_WORDS)]
            self.of = np.concatenate([self.of, *(np.bincount(place, self.amount[bucket]) for place, bucket in found)])
            self.many = np.concatenate([self.many, *(np.bincount(place) for place, _ in found)])
        n = sum(map(len, counted))
        at = np.fromiter((self.ids[w] for words in counted for w in words), np.int64, n)
        times = np.fromiter((x for words in counted for x in words.values()), float, n)
        text = np.repeat(np.arange(len(texts)), [len(words) for words in counted])
        return np.bincount(text, times * self.of[at], len(texts)), np.bincount(text, times * self.many[at], len(texts))


class Model(NamedTuple):
    amount: np.ndarray  # what each bucket adds to the log odds, times the number of features
    bias: float
    slope: float
    shift: float
    blank: float  # score of texts without words

    def score(self, total: float, n: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (total / n + self.bias) + self.shift, -30, 30)))) if n else self.blank


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rows: np.ndarray, seed: int = 1) -> Model:
    """Learns from (buckets, counts) of documents; ``rows`` tells how many labelled rows each stands for."""
    rng = np.random.default_rng(seed)
    blank = np.array([not len(b) for b, _ in docs], bool)
    base = (rows @ labels + 0.5) / (rows.sum() + 1)
    empty = (rows[blank] @ labels[blank] + base) / (rows[blank].sum() + 1)
    use = np.flatnonzero(~blank)
    if len(np.unique(labels[use])) < 2:
        return Model(np.zeros(BUCKETS), float(np.log(base / (1 - base))), 1.0, 0.0, float(empty))
    order = rng.permutation(use)
    held, train = (order[::10], np.setdiff1d(order, order[::10])) if len(order) >= 50 else (order, order)
    share = rows / rows[train].mean()
    vectors, layer, bias = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, 2)), np.zeros(2)
    sums = [np.full_like(x, 1e-8) for x in (vectors, layer, bias)]  # of squared gradients

    def shares(which: np.ndarray) -> np.ndarray:
        """Each document's share of features in every bucket."""
        x = np.zeros((len(which), BUCKETS))
        for row, i in zip(x, which, strict=True):
            row[docs[i][0]] = docs[i][1] / docs[i][1].sum()
        return x

    def odds(which: np.ndarray, amount: np.ndarray, b: float) -> np.ndarray:
        return np.array([docs[i][1] @ amount[docs[i][0]] / docs[i][1].sum() + b for i in which])

    best = (np.inf, np.zeros(BUCKETS), 0.0)
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for k in range(0, len(order), BATCH):
            which = order[k : k + BATCH]
            x = shares(which)
            mean = x @ vectors
            wrong = _softmax(mean @ layer + bias)
            wrong[np.arange(len(which)), labels[which].astype(int)] -= 1
            wrong *= share[which, None] / len(which)
            for value, total, step in zip((vectors, layer, bias), sums, (x.T @ (wrong @ layer.T), mean.T @ wrong, wrong.sum(0)), strict=True):
                total += step**2
                value -= RATE * step / np.sqrt(total)
        amount, b = vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])
        z = odds(held, amount, b)
        loss = float(rows[held] @ np.logaddexp(0, np.where(labels[held] == 1, -z, z)) / rows[held].sum())
        if loss < best[0]:
            best = (loss, amount, b)
    _, amount, b = best
    slope, shift = scaled(odds(held, amount, b), labels[held], rows[held])
    return Model(amount, b, slope, shift, float(empty))


def scaled(z: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make log odds fit the labels best (Newton steps with a small pull to slope 1 and shift 0)."""
    x, theta = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    w, pull = rows / rows.mean(), np.array([1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (w * (p - labels)) + pull * (theta - [1.0, 0.0])
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag(pull), grad)
        theta -= step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
    return float(max(theta[0], 0.05)), float(theta[1])


def sample(docs: DataFrame, labels: DataFrame, size: int = FIT) -> DataFrame:
    """doc_id, text, quality and rows (labelled training rows that the row stands for) of the rows to learn from."""
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    train = marked.where(F.pmod(id_hash(F.col("doc_id")), F.lit(5)) != 0)
    sizes = {r["quality"]: r["count"] for r in train.groupBy("quality").count().collect()}
    order = F.xxhash64("doc_id", F.lit("quality"))
    picked = [train.where(F.col("quality") == y).orderBy(order, "doc_id").limit(size).withColumn("rows", F.lit(sizes.get(y, 0) / max(1, min(size, sizes.get(y, 0))))) for y in (0, 1)]
    # At most 2 x size slim rows.
    return docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("rows").alias("rows"))


def train(rows: DataFrame) -> Model:
    """Counts features wherever the rows are, and fits the model in one task that holds a bounded sample."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [counts_of(t) for t in batch["text"]]
            yield batch.drop(columns="text").assign(buckets=[b.astype(np.int32).tobytes() for b, _ in found], counts=[n.astype(np.float32).tobytes() for _, n in found])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not sum(map(len, parts)):
            return
        all_rows = pd.concat(parts).sort_values("doc_id")
        docs = [(np.frombuffer(b, np.int32), np.frombuffer(n, np.float32).astype(float)) for b, n in zip(all_rows["buckets"], all_rows["counts"], strict=True)]
        m = fit(docs, all_rows["quality"].to_numpy(float), all_rows["rows"].to_numpy(float))
        yield pd.DataFrame({"amount": [m.amount], "rest": [list(m[1:])]})

    counted = stash(rows.mapInPandas(count, "doc_id long, quality int, rows double, buckets binary, counts binary"), "quality-sample")
    found = counted.coalesce(1).mapInPandas(learn, "amount array<double>, rest array<double>").collect()
    return Model(np.array(found[0]["amount"]), *found[0]["rest"]) if found else Model(np.zeros(BUCKETS), 0.0, 1.0, 0.0, 0.5)


def score(docs: DataFrame, labels: DataFrame, size: int = FIT) -> DataFrame:
    """doc_id and score (probability of label 1) of each row."""
    model = train(sample(docs, labels, size).select("doc_id", F.col("quality").cast("int").alias("quality"), "rows", "text"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = worker_cache("fast-quality")
        if "words" not in held or not np.array_equal(held["words"].amount, model.amount):
            held["words"] = Amounts(model.amount)
        for batch in batches:
            texts, scores = list(batch["text"]), []
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum([len(t or "") for t in texts]) // SLICE_LETTERS)) + 1), len(texts)]
            for a, b in itertools.pairwise(cuts):
                scores += [model.score(total, n) for total, n in zip(*held["words"].sums(texts[a:b]), strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": scores})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(judge, "doc_id long, score double")
