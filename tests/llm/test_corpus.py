"""Operators on whole tables: shards, mixing, near-duplicates, toxicity, top-k, language model, pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.cases import LOW, SCHEMA, documents, frame, words

ROWS = documents()
SF = "/root/testdata/sf0.01"


def test_shards_are_even_and_slots_gapless(spark):
    from tidemark.llm import sharding

    rows = ROWS + [(77, "hot copy", "en", "a", 8)] * 400 + [(None, "null id", "en", "a", 7)] * 3
    got = sharding.shard(frame(spark, rows), 40).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in shards.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
        assert abs(sum(r["size"] for r in s) - total / 40) <= largest + total / 40 * 0.01 + 200
    assert sharding.shard(frame(spark, []), 40).count() == 0


def test_mix_equals_its_sql(spark):
    from tidemark.llm import mixing

    rows = ROWS + [(None, "null id here", "en", None, 7), (8000, None, None, "empty source", None)]
    con = duckdb.connect()
    import pandas as pd

    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"}))
    want = sorted(con.execute(mixing.ORACLE).fetchall(), key=repr)
    from tidemark.llm.registry import op8_pareto_mix  # noqa: F401  the same columns in the same order

    from pyspark.sql import functions as F

    df = mixing.mix(mixing.sized(frame(spark, rows)))
    got = sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")), "source", "copies").collect()), key=repr)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    by = defaultdict(list)
    for doc_id, size, source_size, target, taken, source, _ in got:
        assert taken <= 2 * size
        by[source].append((size, source_size, target, taken))
    for s in by.values():
        assert abs(sum(x[3] for x in s) - s[0][2]) <= max(x[0] for x in s) / 2 + 1
    assert sum(s[0][2] for s in by.values()) == pytest.approx(1.5 * sum(s[0][1] for s in by.values()))
    assert mixing.mix(mixing.sized(frame(spark, []))).count() == 0


def brute_components(rows, shingle, percent):
    sets, parent = {}, {}
    for doc_id, text, *_ in rows:
        w = words((text or "").translate(LOW))
        n = min(shingle, len(w))
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        parent[doc_id] = doc_id

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    posts = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for g in sets[i] for j in posts[g])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in sets[i]:
            posts[g].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_rows():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [str(x) for x in rng.choice(vocabulary, 300)]
    out, at = [], 20_000
    for k in range(120):  # a large group of near copies at many distances, and chains of small changes
        w = list(base)
        for i in rng.integers(0, 300, k % 12):
            w[i] = f"new{k}x{i}"
        out.append((at + k, " ".join(w), "en", "a", None))
    for k in range(60):  # documents that share a long passage only
        out.append((at + 500 + k, " ".join(base[:150]) + " " + " ".join(f"own{k}y{i}" for i in range(180)), "en", "a", None))
    for k in range(40):
        out.append((at + 700 + k, " ".join(str(x) for x in rng.choice(vocabulary, int(rng.integers(1, 14)))), "en", "a", None))
    return out


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, shingle, percent):
    from tidemark.llm import near_dup

    rows = ROWS + near_rows()
    want = brute_components(rows, shingle, percent)
    got = near_dup.near_duplicates(frame(spark, rows + [(None, "null id", "en", "a", 7)]), shingle, percent).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_documents_that_many_meet_are_compared_in_blocks(spark, monkeypatch):
    """Three groups of near copies that are not linked with each other, and short texts of a few frequent words."""
    from tidemark.llm import near_dup

    monkeypatch.setattr(near_dup, "FEW", 3)
    monkeypatch.setattr(near_dup, "BLOCK", 64)
    monkeypatch.setattr(near_dup, "MEMBERS", 16)
    rng = np.random.default_rng(11)
    shared, rows = [f"s{i}" for i in range(150)], []
    for g in range(3):
        own = [f"g{g}x{i}" for i in range(30)]
        for k in range(400):
            w = shared + own
            for i in rng.integers(0, 180, k % 9):
                w[i] = f"new{g}y{k}z{i}"
            rows.append((50_000 + 1000 * g + k, " ".join(w), "en", "a", None))
    rows += [(60_000 + k, " ".join(rng.choice(["p", "q", "r"], int(rng.integers(8, 12)))), "en", "a", None) for k in range(400)]
    for shingle, percent in ((3, 85), (5, 80)):
        want = brute_components(rows, shingle, percent)
        got = near_dup.near_duplicates(frame(spark, rows, False), shingle, percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_rows_of_one_id_are_one_document(spark):
    from tidemark.llm import near_dup

    one, other = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, one, "en", "a", 1), (7, other, "en", "a", 1), (7, one, "en", "a", 1), (7, None, "en", "a", 1), (9, other, "en", "a", 1), (None, one, "en", "a", 1)]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dup.near_duplicates(frame(spark, rows)).collect())
    assert got == [(0, 0, True), (1, 1, True), (7, 1, False), (7, 1, False), (7, 1, False), (9, 9, True)]


def test_near_duplicates_of_an_empty_table(spark):
    from tidemark.llm import near_dup

    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_register_estimate_is_close():
    from tidemark.llm import near_dup as nd

    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.9):
        n = 4000
        both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64) * np.uint64(2)])) for _ in range(2))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ra, rb = nd.registers([nd._mix(a), nd._mix(b)], 320)
        assert abs((ra == rb).mean() - j) < 0.1


def test_nearest_examples_are_exact():
    from tidemark.llm.toxicity import BlockMaxIndex

    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(500):
        t = rng.choice(60, int(rng.integers(1, 8)), replace=False)
        w = rng.random(len(t)) + 0.1
        vectors.append(dict(zip(map(int, t), map(float, w / np.sqrt((w * w).sum())))))
    index = BlockMaxIndex(vectors, 60)
    fewer = 0
    for q in vectors[:80]:
        cosines = [(sum(w * v.get(t, 0) for t, w in q.items()), i) for i, v in enumerate(vectors)]
        want = sorted(((round(-c, 9), i) for c, i in cosines if c > 0))[:15]
        near, looked = index.nearest(q, 15)
        assert [i for _, i in near] == [i for _, i in want]
        fewer += looked < index.most.shape[1]
    assert fewer > 0


def test_alike_terms_are_one_and_batches_find_the_same():
    from tidemark.llm import toxicity as t

    rng = np.random.default_rng(6)
    # Terms 2k and 2k + 1 occur equally often everywhere, but in queries not.
    counted = [(np.sort(np.concatenate([2 * x, 2 * x + 1])), np.repeat(rng.integers(1, 4, len(x)), 2)) for x in (np.sort(rng.choice(40, 6, replace=False)) for _ in range(200))]
    weight = rng.random(80) + 0.5
    group = t.alike(counted, 80)
    assert group.max() + 1 <= 40 and (group[::2] == group[1::2]).all()
    merge = t.Merge(group, weight)
    plain = t.BlockMaxIndex([t._unit(x, weight) for x in counted], 80)
    merged = t.BlockMaxIndex([merge(t._unit(x, weight)) for x in counted], merge.n)
    queries = [t._unit((np.sort(rng.choice(80, n, replace=False)), rng.integers(1, 5, n)), weight) for n in (0, 1, 9, 30) for _ in range(30)]
    want = [plain.nearest(q, 15)[0] for q in queries]
    for got in ([merged.nearest(merge(q), 15)[0] for q in queries], list(merged.nearest_of([merge(q) for q in queries], 15))):
        assert [[i for _, i in x] for x in got] == [[i for _, i in x] for x in want]
        assert all(abs(a - b) < 1e-12 for x, y in zip(got, want) for (a, _), (b, _) in zip(x, y))


def test_toxicity_holds_little_beside_its_index():
    """Alike terms take a number for each posting, and what is sent is written without a copy of all its arrays."""
    import pickle
    import tracemalloc

    import numpy as np

    from tidemark.llm import toxicity as t

    rng = np.random.default_rng(4)
    counted = [(np.sort(rng.choice(20_000, 2_000, replace=False)).astype(np.int32), np.ones(2_000, np.int32)) for _ in range(300)]
    most = []

    def traced(f):
        tracemalloc.start()
        try:
            return f()
        finally:
            most.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()

    group = traced(lambda: t.alike(counted, 20_000))
    assert most[0] < 32 * 600_000  # bytes for each posting, of which up to 8 are the groups' keys
    weight = np.ones(20_000)
    merge = t.Merge(group, weight)
    vectors = [merge(t._unit(x, weight)) for x in counted]
    want = t.BlockMaxIndex(list(vectors), merge.n)
    index = t.BlockMaxIndex(t._taken(vectors, list(range(300))), merge.n)
    assert vectors == [None] * 300 and all(np.array_equal(getattr(index, k), getattr(want, k)) for k in ("dense", "exact", "weight", "starts", "example"))
    search = t.Search(index, np.zeros((20_000, 6), np.int32), weight, merge)
    size = sum(x.nbytes for o in (search, index, merge) for x in vars(o).values() if isinstance(x, np.ndarray))
    state = traced(search.__getstate__)
    assert most[1] < size / 2 and len(state) < size / 4
    again = pickle.loads(pickle.dumps(search))
    assert all(np.array_equal(getattr(again.index, k), getattr(index, k)) for k in ("dense", "exact", "weight", "starts", "example", "column", "rows"))


def test_toxicity_sends_its_index_once(spark, monkeypatch):
    from tidemark.llm import toxicity as t

    sent = []
    monkeypatch.setattr(t.BlockMaxIndex, "__getstate__", lambda self: sent.append(1) or self.__dict__)
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 3}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(60)], "doc_id long, toxic int")
    assert t.score(docs, labels).count() == 60 and len(sent) == 1


def test_toxicity_has_one_python_worker_for_each_task(spark, monkeypatch):
    """A Python function on another's rows takes a second worker, and each worker keeps the index."""
    from pyspark.sql.classic.dataframe import DataFrame

    from tidemark.llm import toxicity as t

    stacked = []
    for name in ("mapInPandas", "mapInArrow"):

        def noted(self, *args, plain=getattr(DataFrame, name), **more):
            stacked.append(self._jdf.queryExecution().analyzed().nodeName() in ("MapInPandas", "MapInArrow", "PythonMapInArrow"))
            return plain(self, *args, **more)

        monkeypatch.setattr(DataFrame, name, noted)
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 3}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(60)], "doc_id long, toxic int")
    assert t.score(docs, labels).count() == 60 and len(stacked) > 4 and not any(stacked)


def test_terms_are_found_by_batch_as_word_by_word():
    import pyarrow as pa

    from tidemark.llm import toxicity as t

    known = ["Straße", "strategy", "it's", "ΟΔΟΣ", "İx", "abcdefghij", "ab"]
    names = sorted(set().union(*map(t.terms_of, known)))
    terms = t.Terms("\n".join(names))
    texts = ["STRASSE straße\x1f(Straße)\u00a0strat", None, "", " ... ", "ΟΔΟΣ, οδοσ İX abcdefgzzz abcdz ab abc* it's IT'S", "unknown"]
    for text, last, n in zip(texts, *terms.last(pa.array(texts)), strict=True):
        want = Counter()
        for w in (text or "").split():
            found = t.terms_of(w) & set(names)
            if found:
                want[max(found, key=lambda x: (not x.endswith("*"), len(x)))] += 1
        assert dict(zip((names[i] for i in last.as_py()), n.as_py())) == want and last.as_py() == sorted(last.as_py())
    for row, name in zip(terms.above(), names):
        assert {names[i] for i in row if i < len(names)} == (t.terms_of(name) if not name.endswith("*") else {name[:k] + "*" for k in t.BEGINNINGS if k < len(name)})


def test_neighbours_that_single_precision_confuses():
    from tidemark.llm import toxicity as t

    rng = np.random.default_rng(7)
    first = rng.random(40) + 0.5
    vectors = []
    for i in range(300):
        w = first.copy()
        w[i % 40] += 1e-8 * (i // 40)
        vectors.append((np.arange(40), w / np.sqrt(w @ w)))
    queries = [vectors[i] for i in range(0, 300, 29)]
    index = t.BlockMaxIndex(vectors, 40)
    for q, batch in zip(queries, index.nearest_of(queries, 15), strict=True):
        exact = np.array([q[1] @ w for _, w in vectors])
        want = np.lexsort((np.arange(300), -np.round(exact, 9)))[:15].tolist()
        assert [i for _, i in batch] == want == [i for _, i in index.nearest(q, 15)[0]]


def test_toxicity_on_held_out_labels(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.common import id_hash, table
    from tidemark.llm.toxicity import score

    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").withColumn("toxic", F.lit(0)).withColumn("terms", F.lit(0))
    r = score(docs, labels).join(labels, "doc_id").where(F.pmod(id_hash(F.col("doc_id")), F.lit(4)) == 2)
    n = {(x["toxic"], x["p"]): x["count"] for x in r.groupBy("toxic", (F.col("score") >= 0.3).alias("p")).count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.8
    assert n[1, True] / (n[1, True] + n.get((0, True), 0)) > 0.9


def plain_toxicity(rows, labels):
    """score and evidence of each text by plain dictionaries: all cosines, votes, and pools merged until they rise."""
    from tidemark.llm import toxicity as t

    train = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    counted = {i: Counter(x for w in (text or "").split() for x in t.terms_of(w)) for i, text in rows}
    known = {i: counted[i] for i in train}
    p, n = sum(train.values()), len(train)
    has = {x: [i for i in known if known[i][x]] for x in set().union(*known.values())}
    weight = {}
    for x, ids in has.items():
        a, b = sum(train[i] for i in ids), sum(1 - train[i] for i in ids)
        told = 1 + n * (a * (n - p - b) - b * (p - a)) ** 2 / ((a + b) * (n - a - b) * p * (n - p)) if a * (n - p) > b * p and a + b < n else 1
        weight[x] = told * (math.log((len(rows) + 1) / (sum(bool(c[x]) for c in counted.values()) + 1)) + 1)

    def unit(c):
        v = {x: (1 + math.log(k)) * weight[x] for x, k in c.items() if x in weight}
        norm = math.sqrt(sum(y * y for y in v.values()))
        return {x: y / norm for x, y in v.items()}

    vectors = {i: unit(c) for i, c in known.items() if c}
    base = (p + 0.5) / (n + 1)
    blank = [i for i in known if not known[i]]
    base = (sum(train[i] for i in blank) + base) / (len(blank) + 1)

    def judged(v, leave=None):
        near = sorted(((-round(sum(y * u.get(x, 0) for x, y in v.items()), 9), i) for i, u in vectors.items() if i != leave))
        near = [(-c, i) for c, i in near if c < 0][: t.NEAREST]
        votes = sum(c * c for c, _ in near)
        return (sum(c * c * train[i] for c, i in near) + t.PRIOR_VOTES * base) / (votes + t.PRIOR_VOTES) if near else base, [i for _, i in near]

    pools = []
    own = sorted((round(s / t.KNOT), s, train[i]) for i in vectors for s in [judged(vectors[i], i)[0]])
    for k in sorted({k for k, *_ in own}):
        mine = [(s, y) for step, s, y in own if step == k]
        pools.append((len(mine), sum(y for _, y in mine), sum(s for s, _ in mine)))
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            a, b = pools.pop(), pools.pop()
            pools.append(tuple(x + y for x, y in zip(a, b)))
    at, rate = [s / k for k, _, s in pools], [(y + 0.5) / (k + 1) for k, y, _ in pools]
    out = {}
    for i, c in counted.items():
        share, near = judged(unit(c))
        out[i] = (float(np.interp(share, at, rate)) if near else base, near)
    return out


def test_toxicity_equals_plain_votes(spark):
    from tidemark.llm.toxicity import score

    rng = np.random.default_rng(12)
    plain = [f"{a}{b}{c}" for a in "bdfg" for b in ("ara", "elo", "iru") for c in ("ne", "so", "ti")]
    rude = ["vilewort", "vilest", "grimmer", "grimly"]
    rows, labels = [], {}
    for i in range(160):
        w = [str(x) for x in rng.choice(plain, 12)]
        toxic = int(rng.random() < 0.4)
        if toxic and rng.random() < 0.9 or rng.random() < 0.05:
            w[0] = str(rng.choice(rude))
        rows.append((i, " ".join(w)))
        if i < 120:
            labels[i] = toxic
    rows += [(200, None), (201, ""), (202, "unheard words only"), (203, "Vilewort!")]
    labels[201] = 1
    want = plain_toxicity(rows, labels)
    marks = spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    got = score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), marks).collect()
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]][0], abs=1e-6) and list(r["evidence"]) == want[r["doc_id"]][1], r


def test_rates_rise_with_shares():
    from tidemark.llm.toxicity import isotonic

    shares = np.array([0.05, 0.1, 0.2, 0.3, 0.6, 0.9])
    at, rate = isotonic(shares, np.array([0.0, 1.0, 0.0, 0.0, 1.0, 1.0]), np.ones(6))
    assert (np.diff(at) > 0).all() and (np.diff(rate) > 0).all() and rate[0] < 0.5 < rate[-1]
    assert isotonic(np.zeros(0), np.zeros(0), np.zeros(0))[0].size == 0


def test_toxicity_of_hard_rows(spark):
    from tidemark.llm.toxicity import score

    labels = spark.createDataFrame([(r[0], 1, int(i % 7 == 0)) for i, r in enumerate(ROWS[:100])] * 2 + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = score(frame(spark, ROWS), labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    none = score(frame(spark, ROWS), labels.limit(0)).collect()
    assert len(none) == len(ROWS) and all(r["score"] == 0 for r in none)
    assert score(frame(spark, []), labels).count() == 0


def test_toxicity_of_rare_words_among_many_labels(spark):
    """2000 examples of each class, and telling words that are each in 0.4 % of the toxic examples."""
    from pyspark.sql import functions as F

    from tidemark.llm.common import id_hash
    from tidemark.llm.toxicity import score

    rng = np.random.default_rng(7)
    plain = [f"{a}{b}{c}" for a in "bdfgklmn" for b in ("ara", "elo", "iru", "omi", "uta") for c in ("ne", "so", "ti", "ka")]
    rare = [f"{c}{k}vile" for k, c in enumerate(rng.permutation([f"{x}{y}q" for x in "abcdefghijklmnop" for y in "abcdefghijklmnop"])[:250])]
    rows = []
    for i in range(6000):
        text = list(rng.choice(plain, 30))
        if i % 2:
            text[int(rng.integers(30))] = rare[i // 2 % 250]
        rows.append((i, " ".join(text), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    labels = df.select("doc_id", F.lit(1).alias("quality"), "toxic")
    held = score(df.drop("toxic"), labels).join(labels, "doc_id").where(F.pmod(id_hash(F.col("doc_id")), F.lit(4)) == 2).collect()
    toxic, clean = [r["score"] for r in held if r["toxic"]], [r["score"] for r in held if not r["toxic"]]
    assert len(toxic) > 500 and len(clean) > 500
    assert np.mean(np.array(toxic) >= 0.8) > 0.9 and np.mean(np.array(clean) < 0.5) > 0.9


def brute_top(vectors, k):
    out = []
    for qid in sorted({i for i, _ in vectors if i % 50 == 0}):
        q = min(v for i, v in vectors if i == qid)
        scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != qid)[:k]
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


@pytest.mark.parametrize("subtree", [8192, 40, 6])
def test_tree_search_equals_brute_force(spark, monkeypatch, subtree):
    """With small leaves the tree has several levels, and one common vector fills a leaf that can't be divided."""
    from tidemark.llm import metric_tree as mt

    monkeypatch.setattr(mt, "SUBTREE", subtree)
    monkeypatch.setattr(mt, "FANOUT", 8)
    monkeypatch.setattr(mt, "RUN", 100)
    monkeypatch.setattr(mt, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(subtree)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(400 + i, [0.5] * 8) for i in range(120)]  # one common vector, in ties
    rows += [(600, None), (650, [0.1, None] + [0.0] * 6), (700, [float("nan")] + [0.0] * 7), (750, [float("inf")] + [0.0] * 7), (800, []), (850, [0.3, 0.1]), (None, [1.0] * 8)]
    rows += [(950, [0.9, -0.2] + [0.1] * 6), (950, [-0.7] * 8), (951, [0.9, -0.2] + [0.1] * 6), (1000, [1e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v", "3 AS node", "4 AS score")
    rows = rows[:-1]  # too long for a score that fits a long
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    v = mt.quantized(df)
    got = sorted(tuple(r) for r in mt.top_k(v, v.where("id % 50 = 0")).collect())
    assert got == sorted(brute_top(fine, 5))
    assert mt.top_k(v.limit(0), v.limit(0)).count() == 0


def test_tree_of_large_components(spark):
    from tidemark.llm import metric_tree as mt

    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-(2**20), 2**20, 5)]) for i in range(120)]
    v = mt.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in mt.top_k(v, v.where("id % 50 = 0")).collect())
    assert got == sorted(brute_top([(i, [math.floor(256 * x) for x in w]) for i, w in rows], 5))


def test_tree_skips_distant_pages():
    from tidemark.llm import metric_tree as mt

    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(c, 1, (200, 4)) for c in (-300, 0, 300)]).round()
    most = float((v * v).sum(axis=1).max())
    pivot = mt._lift(v[:1], most)[0]
    tree = mt.Subtree(mt.make_pages(np.arange(len(v)), v, pivot, most), pivot, most)
    q = v[-1]
    got = tree.search(-1, q, 5, -math.inf)
    assert got == sorted(((int(s), i) for i, s in enumerate(v @ q)), key=lambda x: (-x[0], x[1]))[:5]
    assert tree.computed < 300


def held_out(i, n=10):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n == 0


def test_model_base_and_gain(spark):
    from tidemark.llm import hpy_model
    from tidemark.llm.common import table

    docs = table(spark, SF, "documents").select("doc_id", "text")
    hard = spark.createDataFrame([(90_000 + i, r[1]) for i, r in enumerate(ROWS[-20:])] + [(None, "null id"), (90_000, "a repeated id")], "doc_id long, text string")
    both = docs.union(hard)
    rows = [tuple(r) for r in both.collect()]
    clashing = both.selectExpr("*", "'x' AS part", "'y' AS other", "'z' AS kind", "'w' AS body", "1 AS held")
    got = hpy_model.score(clashing).collect()
    assert len(got) == len(rows)
    count = Counter(w for i, t in rows if not held_out(i) for w in words((t or "").translate(LOW)) + [""])
    n, v = sum(count.values()), len(count)
    want = sorted(((-1 if i is None else i), len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, t in rows for w in [words((t or "").translate(LOW)) + [""]])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["held_out"] == held_out(r["doc_id"]) and r["train_tokens"] == n for r in got)
    perplexity = {r["held_out"]: r for r in hpy_model.perplexity(spark.createDataFrame(got)).collect()}
    assert perplexity[True]["perplexity"] < 0.15 * perplexity[True]["base_perplexity"]
    assert perplexity[False]["perplexity"] < 0.02 * perplexity[False]["base_perplexity"]
    assert hpy_model.score(both.limit(0)).count() == 0


def plain_model_scores(docs, discounts, word_class, sweeps=6, burn=2, seed=5):
    """log10 scores of each text by a plain sampler that reseats every customer with all totals up to date."""
    rng = np.random.default_rng(seed)
    texts = {i: words(t.translate(LOW)) + [""] for i, t in docs}
    levels = [{}, {}, {}]  # of (context, word): table sizes; of contexts, classes and the root
    customers, tables = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
    pairs = [(u, w) for i, t in texts.items() if not held_out(i) for u, w in zip([""] + t[:-1], t)]
    uniform = 1 / (len({w for _, w in pairs}) + 1)
    names = lambda u: (u, word_class(u), None)

    def p(level, u, w):
        if level == 3:
            return uniform
        c, d = names(u)[level], discounts[level]
        sizes = levels[level].get((c, w), ())
        return (sum(sizes) - d * len(sizes) + (1 + d * tables[level][c]) * p(level + 1, u, w)) / (1 + customers[level][c])

    def sit(level, u, w):
        if level == 3:
            return
        c, d = names(u)[level], discounts[level]
        sizes = levels[level].setdefault((c, w), [])
        new = (1 + d * tables[level][c]) * p(level + 1, u, w)
        k = int(np.searchsorted(np.cumsum([x - d for x in sizes] + [new]), rng.random() * (sum(sizes) - d * len(sizes) + new), side="right"))
        customers[level][c] += 1
        if k >= len(sizes):
            sizes.append(1)
            tables[level][c] += 1
            sit(level + 1, u, w)
        else:
            sizes[k] += 1

    def rise(level, u, w):
        if level == 3:
            return
        c = names(u)[level]
        sizes = levels[level][c, w]
        k = int(np.searchsorted(np.cumsum(sizes), rng.integers(sum(sizes)), side="right"))
        sizes[k] -= 1
        customers[level][c] -= 1
        if not sizes[k]:
            sizes.pop(k)
            tables[level][c] -= 1
            rise(level + 1, u, w)

    for u, w in pairs:
        sit(0, u, w)
    mean = {i: np.zeros(len(t)) for i, t in texts.items()}
    for n in range(sweeps):
        for u, w in pairs:
            rise(0, u, w)
            sit(0, u, w)
        if n >= burn:
            for i, t in texts.items():
                mean[i] += [p(0, u, w) for u, w in zip([""] + t[:-1], t)]
    return {i: float(np.log10(x / (sweeps - burn)).sum()) for i, x in mean.items()}


@pytest.mark.parametrize("parts", [1, 7])
def test_model_agrees_with_a_plain_sampler(spark, parts):
    from tidemark.llm import hpy_model as h

    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi", "ho") for b in ("n", "r", "st", "t", "ch")]
    after = {w: rng.choice(vocabulary, 4) for w in vocabulary}
    docs = []
    for i in range(60):
        w = [str(rng.choice(vocabulary))]
        for _ in range(60):
            w.append(str(rng.choice(after[w[-1]]) if rng.random() < 0.8 else rng.choice(vocabulary)))
        docs.append((i, " ".join(w)))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    got = h.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    pairs = Counter((u, w) for i, t in docs if not held_out(i) for u, w in zip([""] + t.split(), t.split() + [""]))
    class_of = lambda w: int(h.class_of([w.encode()])[0])
    types1 = Counter(x for x in {(class_of(u), w, u) for u, w in pairs} for x in [x[:2]])
    types0 = Counter(w for _, w in types1)
    share = lambda x: (lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5)(sum(v == 1 for v in x.values()), sum(v == 2 for v in x.values()))
    want = plain_model_scores(docs, [share(pairs), share(types1), share(types0)], class_of)
    ours, plain = np.array([r["score"] for r in got]), np.array([want[r["doc_id"]] for r in got])
    assert abs(ours.sum() / plain.sum() - 1) < 0.02
    assert np.abs(ours / plain - 1).max() < 0.06


def test_seating_has_the_right_number_of_tables():
    """Means over many dishes against the exact law: of n customers at t tables, odds^t times a generalized Stirling number."""
    from tidemark.llm import hpy_model as h

    def mean_tables(n, odds, d):
        s = {0: 1.0}
        for c in range(n):
            s = {t: s.get(t - 1, 0.0) * odds + s.get(t, 0.0) * max(0.0, c - d * t) for t in range(1, c + 2)}
            total = sum(s.values())
            s = {t: x / total for t, x in s.items()}
        return sum(t * x for t, x in s.items())

    rng = np.random.default_rng(1)
    for n, odds, d in ((2, 0.3, 0.5), (5, 0.5, 0.8), (12, 2.0, 0.4), (60, 1.0, 0.7)):
        many, sweeps = (3000, 40) if n < 60 else (500, 400)
        goal, weight = np.full(many, n), np.full(many, odds)
        tables, sizes = h.seated(np.zeros(many, np.int64), np.zeros(0, np.int64), goal, weight, d, rng)
        for _ in range(sweeps):
            tables, sizes = h.seated(tables, sizes, goal, weight, d, rng)
        assert sizes.sum() == many * n and sizes.min() > 0 and len(sizes) == tables.sum()
        assert tables.mean() == pytest.approx(mean_tables(n, odds, d), rel=0.06)
    one = h.crowd(np.zeros(0, np.int64), 60, 1.0, 0.7, rng)
    assert one.sum() == 60
    several = []
    for _ in range(2500):
        one = h.crowd(one, 60, 1.0, 0.7, rng)
        several.append(len(one))
    assert np.mean(several[200:]) == pytest.approx(mean_tables(60, 1.0, 0.7), rel=0.25)
    fewer = h.seated(tables, sizes, np.full(many, 20), weight, d, rng)
    assert fewer[1].sum() == 20 * many and h.seated(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), d, rng)[0].size == 0


def test_small_dishes_are_drawn_by_their_number_of_tables(monkeypatch):
    """Of up to three customers, without seats: the exact law of the number of tables, also as customers come and go."""
    from tidemark.llm import hpy_model as h

    monkeypatch.setattr(h, "Seating", None)
    rng = np.random.default_rng(8)
    many, odds, d = 20_000, 0.7, 0.6
    weight = np.full(many, odds)
    # odds^t times the number of ways, for 2 and 3 customers.
    law = {2: [1 - d, odds], 3: [(1 - d) * (2 - d), odds * 3 * (1 - d), odds * odds]}
    tables, sizes = np.zeros(many, np.int64), np.zeros(0, np.int64)
    for n in (3, 2, 3, 1, 0, 2, 3):
        for _ in range(6):
            tables, sizes = h.seated(tables, sizes, np.full(many, n), weight, d, rng)
            assert sizes.sum() == many * n and len(sizes) == tables.sum() and (np.add.reduceat(sizes, np.cumsum(tables) - tables) == n).all() if n else not len(sizes)
        for t, x in enumerate(law.get(n, []), 1):
            assert (tables == t).mean() == pytest.approx(x / sum(law[n]), abs=0.015)


def test_words_of_the_model_are_those_of_bytes():
    """A batch's words are split, lowered and numbered at once, and give what bytes give one by one."""
    import pyarrow as pa

    from tidemark.llm import hpy_model as h

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000)])).encode()
    texts = [b"skipped", every, b" A  b\t", b"", None, b"\xff\xfe Zz\x0b\x1cq\x85", b"  ", "\u00c9t\u00c9 \u0130".encode()]
    words, n = h.words_of(pa.array(texts, pa.binary())[1:])
    want = [(x or b"").lower().split() for x in texts[1:]]
    assert words.view(pa.binary()).to_pylist() == sum(want, []) and n.tolist() == [len(x) for x in want]
    block = h.Block()
    for i, x in enumerate(texts[1:]):
        block.add(i, x, False)
    names, tokens, lengths = block.coded()
    assert [names[i] for i in tokens] == [w for x in want for w in [*x, h.END]] and lengths.tolist() == [len(x) + 1 for x in want] and len(set(names)) == len(names)
    assert h.class_of([b"", b"a", b"xab", "\u00e9".encode()]).tolist() == [0, (97 & 63) << 5, (98 & 63) << 5 | (97 & 31), (0xA9 & 63) << 5 | (0xC3 & 31)]


def test_a_sweep_moves_as_many_customers_as_a_dish_has():
    """From a table for each customer, a single sweep leaves few tables, in small, large and very large dishes."""
    from tidemark.llm import hpy_model as h

    rng = np.random.default_rng(2)
    for n, many in ((400, 100), (400, 3), (20_000, 1)):
        tables, sizes = h.seated(np.full(many, n), np.ones(n * many, np.int64), np.full(many, n), np.full(many, 0.5), 0.5, rng)
        assert sizes.sum() == n * many and sizes.min() > 0 and len(sizes) == tables.sum() and tables.max() < 0.8 * n
    one = h.crowd(np.ones(100_000, np.int64), 100_000, 0.5, 0.5, rng)
    assert one.sum() == 100_000 and one.min() > 0 and len(one) < 80_000


def test_model_probabilities_sum_to_one(monkeypatch):
    from tidemark.llm import hpy_model as h

    monkeypatch.setattr(h, "CROWD", 20)
    rng = np.random.default_rng(3)
    block = h.Block()
    vocabulary = [f"word{k}{'ab'[k % 2]}" for k in range(30)]
    for d in range(40):
        block.add(d, " ".join(rng.choice(vocabulary, 25)).encode(), False)
    every = [w.encode() for w in vocabulary] + [h.END]
    # A held-out document asks for every word after one word, and for an unknown one.
    block.add(99, b" ".join(b"word1b " + w for w in every[:-1]) + b" word1b unseen word1b", True)
    heavy = np.sort(np.array([h.xxhash.xxh3_64_intdigest(b"word1b")], h.U64))
    g = h.Merged([b for _, _, kind, b in block.rows(0, 1, heavy, True) if kind == h.REQUEST], heavy)
    corpus = h.Corpus(g.stats(1), 1)
    assert corpus.words == 31
    m, once = g.model(), np.bincount(g.c2, g.n2 == 1, len(g.codes))
    where = np.searchsorted(g.codes, m["codes"])
    totals = np.bincount(g.c2, g.n2 > 0, len(g.codes))
    models, tables, corpora = [], [], []
    for n in range(3):
        m, stats = h.sweep(m, totals[where], corpus, (n,))
        corpus = corpus.after(stats, rng)
        totals = once.copy()
        totals[where] += np.bincount(m["context"], m["tables2"], len(where))
        models, tables, corpora = [*models, m], [*tables, totals], [*corpora, corpus]
    p = 10 ** h.predict(g, models, np.bincount(g.c2, g.n2, len(g.codes)), tables, corpora)
    code = [c for c in range(len(g.codes)) if (g.c2 == c).sum() == 32]
    assert len(code) == 1 and p[g.c2 == code[0]].sum() == pytest.approx(1.0, abs=1e-9)


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as cp
    from tidemark.llm import secrets

    spark.conf.set("spark.sql.shuffle.partitions", "4")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stage = dict(cp.STAGES)
    after = {}
    for name, f in cp.STAGES:
        docs = cp.stash(f(spark, docs, SF), "test-stage")
        after[name] = [tuple(r) for r in docs.collect()]
        assert name == "best-fit packing" or docs.columns == columns
    judged, deduped = after["quality rules"], after["near-dedup"]
    want = brute_components(judged, 5, 80)
    assert sorted(r[0] for r in deduped) == sorted(i for i, (_, c) in want.items() if i == c)
    assert sorted(after["secret scan"]) == sorted((i, secrets.redact_text(t), a, s, len(secrets.redact_text(t))) for i, t, a, s, _ in deduped)
    assert not any(re.search("[0-9a-f]{16}", r[1]) for r in after["secret scan"])
    copies = Counter(r[0] for r in after["source mix"])
    assert set(copies.values()) <= {1, 2} and {r[0] for r in after["source mix"]} <= {r[0] for r in deduped}
    packed = Counter(r[0] for r in after["best-fit packing"] if r[1] == 0)
    assert packed == copies
    assert set(stage) == {"quality rules", "near-dedup", "secret scan", "source mix", "best-fit packing"}


ODD = {"a.b": "x.y", "we`ird": "w", "size": "s", "row": "r", "kept": "k", "Text 2": "t"}


def odd_documents(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit(v).alias(k) for k, v in ODD.items()])


def test_pipeline_stages_bear_odd_names_nulls_and_repeats(spark):
    import corpus_pipeline as cp

    rows = documents(60)
    prose = next(t for _, t, lang, *_ in rows if lang == "en" and t and len(words(t)) > 60)
    rows += [rows[0], rows[0], (None, prose, "en", "a", 5), (None, None, None, None, None), (9001, "the client id is Zq8Rk2Lw9Xv4Tn7Bm3Pc6Hd1 and so on", "en", "a", 1)]
    docs = odd_documents(spark, rows)
    mixed_in = None
    for name, f in cp.STAGES[:-1]:
        if name == "source mix":
            mixed_in = docs.collect()
        docs = cp.stash(f(spark, docs, SF), "test-odd")
        assert docs.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), *ODD], name
        assert all(r["a.b"] == "x.y" and r["we`ird"] == "w" for r in docs.collect()), name
    # The mix against its targets: what a source gives is near its target, and no document is taken more than twice.
    size = {}
    for r in mixed_in:
        size[r["source"]] = size.get(r["source"], 0) + len(words(r["text"]))
    order = sorted(size, key=lambda x: (x is None, x or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, rest = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(size.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} if full else share
        rest -= sum(2.0 * size[s] for s in full)
        free = free - full if full else set()
    taken = Counter()
    for r in docs.collect():
        taken[r["source"]] += len(words(r["text"]))
    for s in order:
        largest = max(len(words(r["text"])) for r in mixed_in if r["source"] == s)
        assert abs(taken[s] - target[s]) <= largest, s
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.count() >= docs.count()


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline as cp

    docs = odd_documents(spark, documents(1)[:1]).limit(0)
    for _, f in cp.STAGES:
        docs = cp.stash(f(spark, docs, SF), "test-none")
        assert docs.count() == 0
