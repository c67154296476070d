"""Joins on small fixtures against brute force."""

from tidemark.operators import joins


def test_longest_match_joins_by_equality(spark):
    """Each title meets only its own pieces."""
    titles = ["red widget PSA 9", "infrared widgets", "blue red", "x", "", "no name here", "red widget red widget deluxe", "ıred"]
    names = ["red", "red widget", "widget", "red widget deluxe", "blue", "deluxe", "absent name that is longer than all titles"]
    got = joins.longest_match(spark.createDataFrame([(t,) for t in titles], "title string"), spark.createDataFrame([(n,) for n in [*names, None]], "name string"))
    want = {t: max((n for n in names if n in t), key=lambda n: (-t.index(n), len(n))) for t in titles if any(n in t for n in names)}
    assert {r["title"]: r["name"] for r in got.collect()} == want and got.count() == len(want)


def test_dictionary_query_has_no_cross_join(spark):
    plan = joins.dictionary_longest_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan and "contains(" not in plan.lower()


def test_names_are_found_where_the_rows_are(spark):
    """The same names as by distinct titles and a join, by automaton and by anchors; no row is dealt for the automaton."""
    from tidemark.operators.dictionary import longest_match, with_longest_match

    titles = ["red ring", "a blue ring x", "red", "", None, "ring red ring", "red ring", "zzz", "x y", "été ring"]
    rows = spark.createDataFrame(list(enumerate(titles)), "i int, title string")
    names = spark.createDataFrame([(n,) for n in ["ring", "red ring", "red", "y", "", None, "red", "été"]], "name string")
    found = {r["title"]: r["name"] for r in longest_match(rows.select("title"), names).collect()}
    want = sorted((i, t, found.get(t)) for i, t in enumerate(titles))
    for most in (100, 2):
        df = with_longest_match(rows, names, max_keys=most)
        assert sorted((r["i"], r["title"], r["name"]) for r in df.collect()) == want
        assert ("Join" in df._jdf.queryExecution().optimizedPlan().toString()) == (most == 2)
    assert {r["name"] for r in with_longest_match(rows, names.limit(0)).collect()} == {None}
