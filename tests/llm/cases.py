"""Small tables that hold what operators must bear: nulls, empty and very long texts, copies, ties, clashing columns."""

import random

import pyarrow.parquet as pq

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns they must not disturb.
CLASHES = ("size", "w", "key", "id", "row", "rank", "cell", "bands", "kept", "part", "block", "t", "range", "copies")


def documents(n=150, seed=3):
    """(doc_id, text, lang, source, n_chars) rows: texts of the smallest test table, then the hard cases."""
    rng = random.Random(seed)
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()[:n]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in table]
    base = max(r[0] for r in rows) + 1
    words = "alpha Beta gamma. delta, epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    long = " ".join(rng.choice(words) + str(rng.randrange(3000)) for _ in range(20_000))
    hard = [None, "", " \t\n ", "one", "Two words", "three no break  words", long, long + " end", "x" * 5000, "same text\nsame text\nother", "a b c d e a b c d e a b c d e", "É́ ﬁ ẞ İ K ſ 🙂 |#|", "\x1cfs\x1d gs\x85nel"]
    hard += ["copies of one text are many and they are all the same here"] * 7
    rows += [(base + i, t, rng.choice(["en", "de", None, "xx"]), rng.choice(["a", "b", None]), None if t is None else len(t)) for i, t in enumerate(hard)]
    return rows


def frame(spark, rows, clashes=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES]) if clashes else df


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
