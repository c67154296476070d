"""Estimates by listing, shares above, and sales shown twice, against plain Python."""

import random
import re


def test_share_of_a_sample_above_each_row(spark):
    from tidemark.operators.estimate import shares_above

    rng = random.Random(3)
    sample = [rng.choice([0.0, -0.5, 1.25, rng.uniform(-3, 3)]) for _ in range(300)]
    rows = [(i, rng.choice([0.0, -0.5, 1.25, 9.0, -9.0, rng.uniform(-3, 3)]), "clash") for i in range(200)] + [(900, None, "x"), (901, 0.0, "x"), (901, 0.0, "x")]
    df = spark.createDataFrame(rows, "id int, x double, s string")
    res = spark.createDataFrame([(v,) for v in [*sample, None]], "res double")
    got = sorted((r["id"], r["p"]) for r in shares_above(df, "x", res, "res", "p", 50).collect())
    assert got == sorted((i, None if x is None else sum(v > x for v in sample) / 300) for i, x, _ in rows)
    assert {r["p"] for r in shares_above(df, "x", res, "res", "p", 301).collect()} == {None}
    assert {r["p"] for r in shares_above(df, "x", res.limit(0), "res", "p", 1).collect()} == {None}
    assert shares_above(df.limit(0), "x", res, "res", "p", 1).count() == 0


def test_estimates_put_the_market_back(spark):
    """One market sells everything at twice the price of the other: after many sales a listing's estimate follows its market."""
    import math

    from tidemark.operators.estimate import estimates

    rng = random.Random(5)
    rows = []
    for i in range(3000):
        site, grade, card, rarity = rng.choice(["ASIA", "AFRICA"]), rng.choice([8, 9]), rng.choice("abc"), rng.choice(["PROMO", "SMALL"])
        price = 100 * (2 if site == "ASIA" else 1) * (1 if grade == 9 else 0.5) * (3 if rarity == "PROMO" else 1) * math.exp(rng.gauss(0, 0.05))
        rows.append((card, rarity, "A", grade, site, math.log(price)))
    s = spark.createDataFrame(rows, "card string, rarity string, grader string, grade int, site string, lp double")
    ask = spark.createDataFrame([("a", "PROMO", 9, "ASIA"), ("a", "PROMO", 9, "AFRICA"), ("z", "SMALL", 8, "ASIA"), (None, None, None, None), ("a", "SMALL", 9, "EUROPE")], "card string, rarity string, grade int, site string")
    got = {(r["card"], r["site"]): (math.exp(r["est"]), r["level"]) for r in estimates(s, ask).collect()}
    near = lambda x, y: abs(x / y - 1) < 0.05
    assert near(got["a", "ASIA"][0], 600) and near(got["a", "AFRICA"][0], 300) and got["a", "ASIA"][1] == "L1"
    assert near(got["z", "ASIA"][0], 100) and got["z", "ASIA"][1] == "L3"
    assert got[None, None][1] == "L0" and got["a", "EUROPE"][0] > 0
    assert estimates(s.limit(0), ask).count() == 5


def test_counted_sales_give_the_same_estimates(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.estimate import counted, estimates, shares_above

    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice(["PROMO", "SMALL", None]), "A", rng.choice([8, 9]), rng.choice(["ASIA", "AFRICA"]), rng.choice([1.0, 2.0, 4.5]), rng.random() < 0.4) for _ in range(400)]
    s = spark.createDataFrame(rows, "card string, rarity string, grader string, grade int, site string, lp double, calibration boolean")
    c = counted(s)
    assert c.count() < 400 and c.agg(F.sum("sales")).first()[0] == 400
    ask = s.select("card", "rarity", "grade", "site").distinct()
    assert sorted(map(str, estimates(c, ask).collect())) == sorted(map(str, estimates(s, ask).collect()))
    few = s.groupBy("lp").count()
    assert sorted(map(str, shares_above(ask.withColumn("x", F.lit(1.5)), "x", few, "lp", "p", 400, "count").collect())) == sorted(map(str, shares_above(ask.withColumn("x", F.lit(1.5)), "x", s, "lp", "p", 400).collect()))


def test_p_worth_joins_the_market_once(spark, monkeypatch):
    """Listings and sales come from one stored market, and titles aren't dealt to be matched."""
    from tidemark.operators import counting, dictionary, estimate

    reads, keep = [], estimate.kept

    def noted(df, name):
        reads.append((name, len(re.findall(r"Relation \[l_orderkey#\d+L?,l_partkey", df._jdf.queryExecution().optimizedPlan().toString()))))  # the table
        return keep(df, name)

    for module in (counting, dictionary, estimate):
        monkeypatch.setattr(module, "kept", noted)
    assert estimate.p_worth_by_listing(spark, "/root/testdata/sf0.001").count() > 0
    assert [n for n, lines in reads if lines] == ["market"] and sum(lines for _, lines in reads) == 1


def test_p_worth_of_odd_rows_equals_its_sql(spark, tmp_path):
    """Lines shown twice, lines without a number, parts shown twice under other brands, and parts without name, type or size."""
    import duckdb

    from tests.test_parity import connect, ordered, same
    from tidemark import catalog

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    read = lambda t: f"SELECT * FROM '{sf}/{t}.parquet'"
    no_number = f"SELECT * REPLACE (CAST(NULL AS INTEGER) AS l_linenumber) FROM '{sf}/lineitem.parquet' WHERE l_orderkey % 7 = 1"
    odd = f"""SELECT * REPLACE (CASE WHEN p_partkey % 11 = 1 THEN NULL ELSE p_name END AS p_name, CASE WHEN p_partkey % 11 = 2 THEN NULL ELSE p_type END AS p_type, CASE WHEN p_partkey % 11 = 3 THEN NULL ELSE p_size END AS p_size) FROM '{sf}/part.parquet'"""
    tables = {t: read(t) for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()}
    tables["lineitem"] += f" UNION ALL ({read('lineitem')} WHERE l_orderkey % 5 = 0) UNION ALL {no_number}"
    tables["part"] = f"{odd} UNION ALL SELECT * REPLACE ('Brand#99' AS p_brand) FROM ({odd}) WHERE p_partkey % 4 = 0"
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    df = catalog.QUERIES["p_worth_by_listing"](spark, str(tmp_path))
    want = connect(str(tmp_path)).execute(catalog.SQL["p_worth_by_listing"])
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    rows = ordered([tuple(row[i] for i in at) for row in want.fetchall()])
    got = ordered([tuple(row) for row in df.collect()])
    assert len(got) == len(rows) > 1000
    assert all(same(x, y) for a, b in zip(got, rows, strict=True) for x, y in zip(a, b, strict=True))


def test_sales_shown_twice_equal_connected_pairs(spark):
    from tidemark.operators.dual import dual_groups

    rng = random.Random(11)
    rows = [(f"k{i:03d}", rng.choice(["AMERICA", "ASIA", "ASIA", "EUROPE"]), rng.choice([100, 200, None]), rng.choice(["USD", "USD", ""]), rng.choice(["Red  Ring!", "red ring", "blue", None]), rng.choice([None, *range(0, 60_000, 600)]), rng.choice(["A", "A", "A", None, "B"]), 9, "r", "s") for i in range(400)]
    df = spark.createDataFrame(rows, "key string, site string, price long, currency string, title string, sold_at long, grader string, grade int, rarity string, series string")
    norm = lambda t: "red ring" if t and t.lower().startswith("red") else t
    able = [r for r in rows if r[1] in ("AMERICA", "ASIA") and r[2] and r[3] and r[4] and r[5] is not None]
    link = {r[0]: r[0] for r in able}

    def root(k):
        while link[k] != k:
            k = link[k]
        return k

    for a in able:
        for b in able:
            if a[1] != b[1] and a[2:4] == b[2:4] and norm(a[4]) == norm(b[4]) and abs(a[5] - b[5]) <= 3600:
                link[root(a[0])] = root(b[0])
    groups = {}
    for r in able:
        groups.setdefault(root(r[0]), []).append(r)
    want = {}
    for g in groups.values():
        if len({r[1] for r in g}) == 2:
            keep = min(g, key=lambda r: (r[1] != "AMERICA", r[5], r[0]))
            conflict = "grader" if len({r[6] for r in g} - {None}) > 1 else ""
            want |= {r[0]: (keep[0], bool(conflict) or r is keep, abs(r[5] - keep[5]) / 60, conflict, len(g)) for r in g}
    got = {r["key"]: (r["keep_key"], r["stays"], r["minutes_apart"], r["conflicts"], r["sales"]) for r in dual_groups(df).collect()}
    assert got == want and len(want) > 50 and {c for *_, c, _ in want.values()} == {"", "grader"}
