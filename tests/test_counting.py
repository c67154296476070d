"""Places and medians by counting against plain Python."""

import math
import random
import statistics

import pytest


def rows():
    rng = random.Random(4)
    out = [(rng.choice("ab"), rng.randrange(6), rng.choice([1.5, 2.0, -3.0, 0.0, rng.random() * 1000, 1e12 * rng.random()])) for _ in range(400)]
    return out + [("hot", 1, 5.0)] * 200 + [("one", 1, 2.0), ("two", 1, 1.0), ("two", 2, 4.0), ("two", 2, None)]


def test_places_and_medians(spark):
    from tidemark.operators.counting import medians, placed

    df = spark.createDataFrame(rows(), "cell string, seller int, value double")
    got = {}
    for r in placed(df, ["cell"], "value", "seller").collect():
        got.setdefault(r["cell"], []).append((r["place"], r["value"], r["of"]))
    for cell, found in got.items():
        want = sorted(v for c, _, v in rows() if c == cell and v is not None)
        assert [v for _, v, _ in sorted(found)] == want and sorted(p for p, *_ in found) == list(range(len(want))) and {n for *_, n in found} == {len(want)}
    assert {(r["cell"], r["n"]): r["mid"] for r in medians(df, ["cell"], "value").collect()} == {(c, len(x)): statistics.median(x) for c in got for x in [[v for k, _, v in rows() if k == c and v is not None]]}
    for share in (0.25, 0.9):
        got_at = {r["cell"]: r["mid"] for r in medians(df, ["cell"], "value", share=share).collect()}
        for c in got:
            v = sorted(v for k, _, v in rows() if k == c and v is not None)
            at = (len(v) - 1) * share
            assert math.isclose(got_at[c], v[int(at)] + (v[math.ceil(at)] - v[int(at)]) * (at - int(at)), rel_tol=1e-9, abs_tol=1e-9)
    assert medians(df, [], "value").first()["mid"] == statistics.median(v for *_, v in rows() if v is not None)
    assert placed(df.limit(0), ["cell"], "value").count() == 0


def test_medians_of_stored_rows_count_each_by_its_weight(spark):
    """Only rows of the middle buckets are dealt; the same as medians of the rows repeated."""
    from tidemark.operators.counting import stored_medians

    rng = random.Random(8)
    data = [(c, s % 2, v, rng.randrange(1, 4)) for c, s, v in rows()] + [("far", 0, -7.5, 1), ("far", 0, 2000.0, 1)]
    df = spark.createDataFrame(data, "cell string, part int, value double, n_sales long")
    for by, key in (([], lambda c, p: ()), (["cell"], lambda c, p: (c,)), (["cell", "part"], lambda c, p: (c, p))):
        want = {}
        for c, p, v, n in data:
            if v is not None:
                want.setdefault(key(c, p), []).extend([v] * n)
        found = stored_medians(df, by, "value", "n_sales")
        assert {tuple(r[b] for b in by): (r["mid"], r["n"]) for r in found.collect()} == {k: (statistics.median(v), len(v)) for k, v in want.items()}
    assert stored_medians(df.limit(0), ["cell"], "value", "n_sales").count() == 0
    assert [tuple(r) for r in stored_medians(df.limit(0), [], "value", "n_sales").collect()] == [(None, None)]


def test_median_of_the_others(spark):
    from tidemark.operators.counting import others_median

    df = spark.createDataFrame(rows(), "cell string, seller int, value double")
    want = {}
    for cell, seller, _ in rows():
        others = [v for c, s, v in rows() if c == cell and s != seller and v is not None]
        if len(others) >= 1:
            want[cell, seller] = (len(others), statistics.median(others))
    assert {(r["cell"], r["seller"]): (r["others"], r["mid"]) for r in others_median(df, ["cell"], "seller", "value", 1).collect()} == want


@pytest.mark.parametrize("cell_rows", [10**6, 50])
def test_rows_with_the_median_of_the_others(spark, cell_rows):
    from tidemark.operators.counting import with_others_median

    rng = random.Random(7)
    data = [(i, c, rng.choice("xy"), s, v) for i, (c, s, v) in enumerate(rows())]
    df = spark.createDataFrame(data, "id int, cell string, part string, seller int, value double").repartition(3)
    got = {r["id"]: (r["n1"], r["m1"], r["n2"], r["m2"]) for r in with_others_median(df, ["cell"], {"1": ("cell", "part"), "2": ("cell",)}, "seller", "value", 2, cell_rows).collect()}

    def others(pick):
        return (len(pick), statistics.median(pick)) if len(pick) >= 2 else (None, None)

    for i, cell, part, seller, value in data:
        near = [(p, v) for _, c, p, s, v in data if c == cell and s != seller and v is not None]
        want = (*others([v for p, v in near if p == part]), *others([v for _, v in near])) if value is not None else (None,) * 4
        assert got[i] == want, (i, cell, part, seller)
    assert len(got) == len(data) and with_others_median(df.limit(0), ["cell"], {"1": ("cell",)}, "seller", "value", 2).count() == 0


def test_equal_values_are_counted_before_they_are_dealt(spark):
    """Nine rows in ten have one value: no stage but the scan sees more than a few rows of it."""
    from tidemark.operators.counting import medians

    df = spark.range(200_000).selectExpr("'all' AS cell", "CASE WHEN id % 10 < 9 THEN 5.0D ELSE CAST(id AS double) END AS value")
    plan = medians(df, ["cell"], "value")
    assert plan.first()["mid"] == 5.0
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in text and "partial_count" in text


def test_seller_report_finds_peers_once(spark, monkeypatch):
    """All parts of the report rest on one search for peers and one stored table."""
    from tidemark.operators import joins, sellers, watch

    calls, stored = [], []
    real, keep = joins.with_others_median, sellers.kept
    monkeypatch.setattr(joins, "with_others_median", lambda rows, by, *a, **k: calls.append((tuple(by), rows.columns)) or real(rows, by, *a, **k))
    monkeypatch.setattr(sellers, "kept", lambda df, name: stored.append(df.columns) or keep(df, name))
    watch.seller_alpha_report(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and calls[0][0] == joins.TIERS[2] and "key" not in calls[0][1]
    assert len(stored) == 1 and "key" not in stored[0]
