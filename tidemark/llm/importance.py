"""Target-distribution importance resampling: documents whose n-grams look like those of a target text are drawn more often.

Features are runs of one or two consecutive words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case. In each
block of texts (BLOCK_BYTES, or one longer text) an integer dictionary maps distinct words to ids, an n-gram is a tuple of ids,
the bytes of each distinct tuple are put together and hashed once, and its bucket is joined back to all of the tuple's places.
The dictionary belongs to a block, as one for the whole corpus would grow with it and cost a shuffle of every word; buckets
don't depend on ids, so the blocks' counts add up. A row keeps two bytes a feature (its buckets), which are written once and
read for the totals and for the weights; the totals and gains have BUCKETS rows, whatever the input.

A document's weight is the floored mean of its features' gains, its score adds Gumbel noise by its id, and the highest scores
are drawn. Ranks come from counts by score: noise has 32 bits, so scores are whole numbers within some 100,000, and documents
are ordered by id only within a score that is drawn from.

Null and empty texts have no features, weight 0 and no rank; texts count whole, however long. A null doc_id counts as an empty
text in the noise and comes before the others in ties. Repeated rows are documents each; rows of one doc_id and equal score get
ranks in an order of their own. With an empty target every gain still is defined. An empty table gives no rows. Columns
other than doc_id and text (target: text) are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import sql_crc32, sql_lower, stash

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
BLOCK_BYTES = 8 << 20

#: ASCII characters that aren't letters or digits part words; bytes of other characters belong to words.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))


class Dictionary(dict):
    """Ids of words, given as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def buckets_of(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and the buckets of all features: each text's words and then its pairs of words."""
    ids = Dictionary()
    words = [t.translate(_WORDS).split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    place = np.fromiter((ids[w] for text in words for w in text), np.int64, int(n.sum()))
    names = list(ids)
    single = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % buckets
    ends = np.cumsum(n)
    follows = np.ones(max(0, len(place) - 1), bool)
    follows[ends[(ends > 0) & (ends < len(place))] - 1] = False  # the next word is another text's
    pairs = ((place[:-1] << 32) | place[1:])[follows]
    tuples, back = np.unique(pairs, return_inverse=True)
    double = np.fromiter((zlib.crc32(names[a] + b" " + names[b]) for a, b in zip((tuples >> 32).tolist(), (tuples & 0xFFFFFFFF).tolist(), strict=True)), np.int64, len(tuples)) % buckets
    out = np.empty(len(place) + len(pairs), np.uint16)
    n_pairs = np.maximum(n - 1, 0)
    before = np.cumsum(n_pairs) - n_pairs  # pairs of earlier texts
    out[np.arange(len(place)) + np.repeat(before, n)] = single[place]
    out[np.arange(len(pairs)) + np.repeat(ends, n_pairs)] = double[back.reshape(-1)]
    return n, out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the buckets of all features (two bytes each) of every row."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = [(t or "").encode() for t in batch["text"]], batch["doc_id"].astype("Int64")
            size = np.cumsum([len(t) for t in texts])
            cuts = np.flatnonzero(np.diff(size // BLOCK_BYTES)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
                n, of = buckets_of(texts[a:b])
                ends = np.cumsum(n + np.maximum(n - 1, 0))
                rows = [x.tobytes() for x in np.split(of, ends[:-1])] if b > a else []
                yield pd.DataFrame({"doc_id": ids[a:b], "n_words": n, "buckets": rows})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(found, "doc_id long, n_words long, buckets binary")


def totals(featured: DataFrame, name: str) -> DataFrame:
    """bucket and count of features, for buckets that have any: each task adds up its rows first."""

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch["buckets"]), np.uint16), minlength=BUCKETS)
        yield pd.DataFrame({"bucket": np.flatnonzero(n), name: n[n > 0]})

    return featured.select("buckets").mapInPandas(added, f"bucket long, {name} long").groupBy("bucket").agg(F.sum(name).alias(name))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket: a row for each of BUCKETS comes to the driver."""
    rows = totals(source, "s").join(totals(target, "t"), "bucket", "full").toArrow()
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = rows["bucket"].to_numpy()
    s[at], t[at] = rows["s"].fill_null(0).to_numpy(), rows["t"].fill_null(0).to_numpy()
    all_s, all_t = s.sum(), t.sum()
    return np.array([math.floor(1000 * math.log((t[i] + 1) * (all_s + BUCKETS) / ((s[i] + 1) * (all_t + BUCKETS)))) for i in range(BUCKETS)], np.int64)


def weighted(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight."""

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["buckets"].map(len).to_numpy(np.int64) // 2
            of = gain[np.frombuffer(b"".join(batch["buckets"]), np.uint16)]
            sums = np.concatenate([[0], np.cumsum(of)])
            ends = np.cumsum(n)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_words": batch["n_words"], "n_features": n, "weight": (sums[ends] - sums[ends - n]) // np.maximum(n, 1)})

    return featured.mapInPandas(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED):
    """Gumbel noise in thousandths, a whole number, by sha256 of ``<seed>:<doc_id>``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (doc_id, n_words, score and more) with the rank of the drawn documents; the others' is null."""
    able = scored.where(F.col("n_words") >= least_words)
    n = F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)
    # A row for each score; scores lie within some 100,000 by construction.
    before = able.groupBy("score").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("score")))).withColumn("take", n)
    cut = stash(before.where("upto - n < take").select(F.col("score").alias("cut"), F.col("upto").alias("cut_upto"), F.col("n").alias("cut_n"), "take"), "importance-cuts")
    taking = (F.col("n_words") >= least_words) & F.col("cut").isNotNull()
    joined = scored.join(F.broadcast(cut), F.col("score") == F.col("cut"), "left")
    chosen = joined.where(taking).withColumn("rank", F.col("cut_upto") - F.col("cut_n") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first())))
    chosen = chosen.withColumn("rank", F.when(F.col("rank") <= F.col("take"), F.col("rank")).cast("long"))
    rest = joined.where(~taking).withColumn("rank", F.lit(None).cast("long"))
    return chosen.unionByName(rest).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``."""
    source = stash(features(docs), "importance-features")
    gain = gains(source, features(target.select(F.lit(None).cast("long").alias("doc_id"), "text")))
    scored = stash(weighted(source, gain).withColumn("score", F.col("weight") + noise(seed)), "importance-scores")
    return drawn(scored, percent).select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB SQL of the query.
ORACLE = f"""
WITH split AS (SELECT 0 AS side, doc_id, row_number() OVER () AS row, list_filter(regexp_split_to_array({sql_lower("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents
UNION ALL SELECT 1, NULL, row_number() OVER (), list_filter(regexp_split_to_array({sql_lower("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') FROM benchmark),
f AS (SELECT side, row, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM split),
n AS (SELECT side, row, feature, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT feature, {sql_crc32("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM n)),
c AS (SELECT bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS t FROM n JOIN b USING (feature) GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM c),
g AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000))))::BIGINT AS gain FROM c, a),
d AS (SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM n JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 0 GROUP BY row),
h AS (SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM split LEFT JOIN d USING (row) WHERE side = 0),
x AS (SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS able FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= floor(25 * able / 100) THEN place END AS rank FROM r
"""
