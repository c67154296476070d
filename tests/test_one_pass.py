"""Plans that join the large tables once, and medians by one deal."""

import random
import statistics

SF = "/root/testdata/sf0.001"


def passes(df):
    """How often a plan reads lineitem."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")


def test_best_tier_is_looked_up_for_cells(spark):
    from tidemark.operators.aggregates import comparables_best_tier

    assert passes(comparables_best_tier(spark, SF)) == 0  # all from one stored table


def test_pairs_are_found_by_one_deal(spark):
    from tidemark.operators.joins import dual_listing_pairs

    df = dual_listing_pairs(spark, SF)
    assert passes(df) == 1 and " bucket" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_dual_rule_reads_lines_once(spark):
    from tidemark.operators.machines import dual_listing_rule

    assert passes(dual_listing_rule(spark, SF)) == 1


def test_appraisal_reads_stored_asks_and_cheapest_route_as_a_column(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.money import cheapest, quotes
    from tidemark.operators.machines import appraise

    assert passes(appraise(spark, SF)) == 0
    rows = spark.createDataFrame([(s, p) for s in ("ASIA", "AMERICA", "MIDDLE EAST", "MOON") for p in (0.0, 1.005, 99.99)] + [("ASIA", None)], "site string, price double")
    want = {(r["site"], r["price"]): r["least"] for r in quotes(rows).groupBy("site", "price").agg(F.min("landed").alias("least")).collect()}
    assert {(r["site"], r["price"]): r["least"] for r in rows.withColumn("least", cheapest()).collect()} == {(r["site"], r["price"]): want.get((r["site"], r["price"])) for r in rows.collect()}


def test_folds_read_stored_samples(spark):
    from tidemark.operators.study import coverage_hash_folds

    assert passes(coverage_hash_folds(spark, SF)) == 0


def test_sorted_medians_and_metrics_without_maps(spark):
    from tidemark.operators.counting import sorted_medians
    from tidemark.operators.sellers import seller_metrics

    rng = random.Random(3)
    data = [(rng.randrange(9), rng.choice([None, 1.0, 2.5, rng.random()]), rng.choice([None, rng.random()])) for _ in range(300)] + [(10, None, 3.0)]
    got = {r["k"]: r for r in sorted_medians(spark.createDataFrame(data, "k int, a double, b double"), ["k"], ["a", "b"]).collect()}
    assert len(got) == 10
    for k, r in got.items():
        for i, c in ((1, "a"), (2, "b")):
            v = [x[i] for x in data if x[0] == k and x[i] is not None]
            assert (r[f"m_{c}"], r[f"n_{c}"]) == (statistics.median(v) if v else None, len(v))
    assert "collect_set" not in seller_metrics(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_refill_and_projection_passes(spark):
    from tidemark.operators.watch import observation_projection, refill_ledger

    assert passes(refill_ledger(spark, SF)) == 0
    df = observation_projection(spark, SF)
    assert passes(df) == 1 and "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()


def test_dual_groups_across_spans(spark):
    """Chains that cross midnight and gaps of days, against pairs; what is joined at the end is stored."""
    from tidemark.operators.dual import SITES, dual_groups

    rng = random.Random(5)
    times = [86400 * d + x for d in (0, 1, 2, 9) for x in (10, 1700, 3500, 40000, 83000, 84500, 86300)]
    data = [(f"k{i:03}", rng.choice(SITES), float(rng.choice((1, 2))), "USD", "Card", rng.choice(times), "A", 9, "r", "s") for i in range(70)]
    df = dual_groups(spark.createDataFrame(data, "key string, site string, price double, currency string, title string, sold_at long, grader string, grade int, rarity string, series string"))
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    root = {r[0]: r[0] for r in data}

    def find(k):
        return k if root[k] == k else find(root[k])

    # A sale between two linked ones belongs to them: join all that lie in the time of a link.
    for a in data:
        for b in data:
            if a[1] != b[1] and a[2] == b[2] and 0 <= b[5] - a[5] <= 3600:
                for c in data:
                    if c[2] == a[2] and a[5:6] + (a[0],) <= (c[5], c[0]) <= b[5:6] + (b[0],):
                        root[find(c[0])] = find(a[0])
                root[find(b[0])] = find(a[0])
    groups = {}
    for r in data:
        groups.setdefault(find(r[0]), []).append(r)
    want = {r[0]: len(g) for g in groups.values() if len({x[1] for x in g}) == 2 for r in g}
    assert {r["key"]: r["sales"] for r in df.collect()} == want and want


def test_listings_are_priced_without_a_row_for_each_route(spark):
    from tidemark.operators.estimate import listings

    assert "route_site" not in listings(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_third_tier_is_found_only_where_it_is_lacking(spark, monkeypatch):
    """Numbers for names, and the third tier's cells only where rows lack peers in the first two; against pairs."""
    from tidemark.operators import joins

    rng = random.Random(11)
    deals = []
    real = joins.with_others_median
    monkeypatch.setattr(joins, "with_others_median", lambda rows, by, *a, **k: deals.append((tuple(by), rows.count())) or real(rows, by, *a, **k))
    schema = "id int, basis string, kind string, site int, card long, series long, rarity long, grader string, grade int, seller long, price double"
    data = [(i, "ask", "fixed", 1, rng.randrange(3), rng.randrange(2), 1, "A", 9, rng.randrange(6), rng.choice([1.0, 2.5, rng.random()])) for i in range(120)]
    joins.peers(spark.createDataFrame(data, schema)).count()
    assert [by for by, _ in deals] == [joins.TIERS[2]]
    deals.clear()
    # Site 2 has cards of one row each; a row without a price has no peers, and lacks none.
    data += [(200 + i, "ask", "fixed", 2, 100 + i, 1, 1, "A", 9, i % 3, float(i)) for i in range(9)] + [(300, "ask", "fixed", 1, 900, 1, 1, "A", 9, 1, None)]
    got = {r["id"]: (r["tier"], r["n_peers"], r["peer_median"]) for r in joins.peers(spark.createDataFrame(data, schema)).collect()}
    assert deals == [(joins.TIERS[2], 130), (joins.TIERS[3], 9)] and len(got) == len(data)
    names = schema.replace(" int", "").replace(" string", "").replace(" long", "").replace(" double", "").split(", ")
    rows = [dict(zip(names, x)) for x in data]
    for x in rows:
        want = (None, None, None)
        for t, columns in joins.TIERS.items() if x["price"] is not None else ():
            near = [y["price"] for y in rows if y["price"] is not None and y["seller"] != x["seller"] and all(x[c] == y[c] for c in columns)]
            if len(near) >= 3:
                want = (t, len(near), statistics.median(near))
                break
        assert got[x["id"]] == want
