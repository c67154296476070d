"""Spelling variants, importance resampling and the subword classifier against plain Python, SQL and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm.cases import LOW, documents, frame

SF = "/root/testdata/sf0.001"


def hard_rows():
    """The shared cases, repeated rows, a null id, and misspelt copies of a few words."""
    rows = documents()
    base = max(r[0] for r in rows) + 1
    variants = "committee comittee commitee committtee cOmmittee comMittée œcommittee×÷ÀÉcommittee"
    rows += [(base + i, f"{variants} the committee met {'committee ' * 30}", "en", "a", None) for i in range(6)]
    rows.append((base + 6, "abcdefgh " * 40 + "abcdefgx " * 15 + "abcdefyx " * 6, "en", "a", None))  # a chain of forms
    return rows + [(None, "committee " * 40 + "Straße ßtraße naïvely naïvelý", "en", None, 1)] + rows[:2]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, times):
    """word: (form, root, n, n_near, form_n), every pair of words compared."""
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    forms, found = {}, {}
    for w in n:
        others = [o for k in (-1, 0, 1) for o in by_size.get(len(w) + k, ()) if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        forms[w] = best if best and n[best] >= times * n[w] else None
        found[w] = len(others)
    root = {}
    for w in n:
        root[w] = w
        while forms[root[w]]:
            root[w] = forms[root[w]]
    return {w: (forms[w], root[w], n[w], found[w], n[forms[w]] if forms[w] else None) for w in n}


@pytest.mark.parametrize("shard_words,round_bytes", [(1 << 18, 1 << 26), (40, 3000)])
def test_variants_equal_brute_force(spark, shard_words, round_bytes):
    from tidemark.llm import spelling

    rows = hard_rows()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(frame(spark, rows), 2, shard_words, round_bytes).collect()}
    want = plain_variants(rows, 2)
    assert got == want
    assert got["committee"][1] == "committee" and got["comittee"][1] == "committee" and any(f and f != r for f, r, *_ in got.values())


def test_automaton_equals_all_pairs():
    from tidemark.llm.spelling import Trie

    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))).encode("latin-1") for _ in range(300)} | {b"a" * 300, b"a" * 299 + b"b"})
    trie = Trie.of(words, [1] * len(words))
    a, b = trie.near(words)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((i, j) for i, x in enumerate(words) for j, y in enumerate(words) if near(x, y))
    assert trie.near([b"", b"zzz"])[0].tolist() == [0] * sum(len(w) == 1 for w in words)
    assert not len(Trie.of([], []).near([b"abc"])[0]) and not len(trie.near([])[0])


def test_roots_follow_long_chains(spark):
    from tidemark.llm import spelling

    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w3"), ("y", "z")], "word string, form string")
    got = {r["word"]: r["root"] for r in spelling.roots(chain).collect()}
    assert got == {**{f"w{i}": "w11" for i in range(11)}, "x": "w11", "y": "z"}


def test_words_of_a_text_change_once():
    from tidemark.llm import spelling

    # With modulus 1 every run loses a letter; a result that equals another run doesn't lose a second one.
    got = spelling.words_of(7, "abc abc ab A é", modulus=1)
    want = Counter()
    for run, n in (("abc", 2), ("ab", 1), ("a", 1), ("é", 1)):
        at = zlib.crc32(f"7:{run}".encode()) % len(run)
        want[(run[:at] + run[at + 1 :]).encode("latin-1")] += n
    assert got == want
    assert spelling.words_of(None, None) == Counter() and spelling.words_of(1, "łx y🙂z", 10**9) == Counter([b"x", b"y", b"z"])


def features(text):
    w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW)) if x]
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def plain_resample(rows, target, percent=25):
    s, t = Counter(), Counter()
    found = [features(text) for _, text, *_ in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    for _, fs in found:
        s.update(map(bucket, fs))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    S, T = s.total(), t.total()
    out = []
    for (doc_id, *_), (n_words, fs) in zip(rows, found, strict=True):
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in map(bucket, fs)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize("block,target", [(8 << 20, ["alpha beta gamma of the and", None, "", "It was the. "] * 3), (200, [])])
def test_resampling_equals_brute_force(spark, monkeypatch, block, target):
    from tidemark.llm import importance

    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    rows = hard_rows()
    aim = spark.createDataFrame([(t, "clash") for t in target], "text string, score string")
    got = importance.resample(frame(spark, rows), aim).select("doc_id", "n_features", "weight", "score", "rank").collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_resample(rows, target), key=key)


def test_ties_of_scores_go_to_smaller_ids(spark):
    from tidemark.llm import importance

    rows = [(i, 20, 5) for i in range(30, 0, -1)] + [(None, 30, 5), (99, 50, 9), (98, 19, 9)]
    got = {r["doc_id"]: r["rank"] for r in importance.drawn(spark.createDataFrame(rows, "doc_id long, n_words long, score long"), 25).collect()}
    assert len(got) == 33 and {k: v for k, v in got.items() if v} == {99: 1, None: 2, **{i: i + 2 for i in range(1, 7)}}


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_importance_resampling"])
def test_queries_equal_their_sql(spark, name):
    from tidemark.llm import registry

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, df.select(names).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_subword_quality_on_held_out_labels(spark):
    from tidemark.llm import registry

    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in registry.op13_subword_quality(spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    held = [(got[i]["score"], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert len(bad) >= 5 and np.mean([s >= 0.3 for s in good]) >= 0.97 and np.mean([s < 0.3 for s in bad]) >= 0.8
    assert np.mean([(s - y) ** 2 for s, y in held]) < 0.04
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_subword_quality_of_hard_rows(spark):
    from tidemark.llm import fast_quality

    rows = [r for r in hard_rows() if r[0] is None or r[0] > 100]
    rng = random.Random(2)
    prose, junk = "and the river went to a quiet town where people read".split(), "$$x ##y q%% &&z".split()
    rows += [(5000 + i, " ".join(rng.choice(junk if i % 3 == 0 else prose) for _ in range(30)), "en", "a", 1) for i in range(200)]
    labels = [(5000 + i, int(i % 3 > 0)) for i in range(200)] + [(5001, 1), (5002, None), (None, 0), (10**9, 1)]
    held = {5000 + i for i in range(200) if zlib.crc32(str(5000 + i).encode()) % 5 == 0}
    frames = [spark.createDataFrame([(i, y if i not in held else flip(y), "t") for i, y in labels], "doc_id long, quality int, text string") for flip in (lambda y: y, lambda y: 1 - y)]
    got, other = ({(r["doc_id"], round(r["score"], 9)) for r in fast_quality.score(frame(spark, rows), f).collect()} for f in frames)
    assert got == other  # labels of held-out rows change nothing
    scores = fast_quality.score(frame(spark, rows), frames[0]).collect()
    assert len(scores) == len(rows) and all(0 <= r["score"] <= 1 for r in scores)
    by_id = {r["doc_id"]: r["score"] for r in scores}
    assert all((by_id[i] >= 0.5) == ((i - 5000) % 3 > 0) for i in held)
    copies = [by_id[i] for i, t, *_ in rows if t == "copies of one text are many and they are all the same here"]
    assert len(set(copies)) == 1
    assert {r["score"] for r in fast_quality.score(frame(spark, rows), frames[0].limit(0)).collect()} == {0.5}


def test_classifier_learns_rare_marks_and_calibrates():
    from tidemark.llm import fast_quality as q

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(40)) + (" zz##" if i % 4 == 0 else "") for i in range(400)]
    y = np.array([float(i % 4 > 0) if i % 10 else 1.0 for i in range(400)])
    docs = [q.counts_of(t) for t in texts]
    m = q.fit(docs, y, np.ones(400))
    scores = np.array([m.score(m.amount[b] @ n, n.sum()) for b, n in docs])
    marked = np.arange(400) % 4 == 0
    assert scores[marked].mean() < 0.5 < scores[~marked].min() and abs(scores[marked].mean() - y[marked].mean()) < 0.15
    total, n = q.Amounts(m.amount).sums([*texts, None, "", "x" * 3000])
    assert np.allclose(total[:400], [m.amount[b] @ k for b, k in docs]) and n[:400].tolist() == [k.sum() for _, k in docs] and n[400:402].tolist() == [0, 0]
    words, size = ["", "ab", "ßé🙂"], lambda w: 1 + sum(max(0, len(w) + 2 - k + 1) for k in q.GRAMS)
    place, bucket = q.features_of(words)
    assert np.bincount(place).tolist() == [size(w) for w in words] and all(sorted(bucket[place == i]) == sorted(q.features_of([w])[1]) for i, w in enumerate(words))
    assert q.counted_words("a a a b  a")[q.AGAIN] == 2 and not q.counted_words(None)
    assert m.score(0.0, 0.0) == m.blank


def test_empty_tables_of_words(spark):
    from tidemark.llm import fast_quality, importance, spelling

    none = frame(spark, documents(1)[:1]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert spelling.spelling_variants(none).count() == 0
    assert importance.resample(none, none).count() == 0
    assert fast_quality.score(none, labels).count() == 0
