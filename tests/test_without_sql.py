"""Queries that SQL can't express, against plain Python on whole tables."""

import unicodedata
from collections import Counter

from tidemark import catalog

SF = "/root/testdata/sf0.001"


def test_folded_titles(spark):
    from tidemark.sources.views import market, titled

    titles = {r["title"] for r in titled(market(spark, SF)).select("title").collect()}
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t).lower() if unicodedata.category(c)[0] not in "PSZC")
    want = Counter(map(fold, titles))
    assert {r["folded"]: r["spellings"] for r in catalog.QUERIES["fold_titles"](spark, SF).collect()} == want


def test_greedy_cover(spark):
    from tidemark.sources.views import observed

    items = {}
    for r in observed(spark, SF).select("key", "site", "day").collect():
        items.setdefault(r["site"], set()).add((r["key"].split(":")[1], r["day"]))
    want, covered = [], set()
    while len(want) < 5 and items:
        site = min(items, key=lambda s: (-len(items[s] - covered), s))
        if not items[site] - covered:
            break
        want.append((len(want), site, len(items[site] - covered)))
        covered |= items.pop(site)
    assert sorted(tuple(r) for r in catalog.QUERIES["greedy_max_cover"](spark, SF).collect()) == want


def test_cards_and_grades_of_all_titles(spark):
    """The stand-in's titles and descriptions are made from numbers, so what is in them is known from the numbers."""
    from tidemark.operators.cards import described
    from tidemark.sources.views import market

    want, titles = Counter(), {}
    rows = described(market(spark, SF)).select("key", "title", "description", "grader", "grade", "quantity").distinct().collect()
    for r in rows:
        service, d = {"A": "PSA", "N": "BGS"}.get(r["grader"], "ARS"), r["quantity"] % 6
        said = {1: [("PSA", r["grade"])], 2: [("BGS", r["grade"])], 4: [("PSA", 8), ("PSA", 9)]}.get(d, [])
        if r["quantity"] % 7 != 0:
            titles[r["title"]] = (service, r["grade"])
            clash = any(s == service and g != r["grade"] for s, g in said)
            out = (service, None, None, True) if clash else (service, r["grade"], "title", False)
        else:
            titles[r["title"]] = (None, None)
            out = (None, None, None, True) if len(said) > 1 else (*said[0], "description", False) if said else (None, None, None, False)
        want[r["key"], *out] += 1
    got = Counter((r["key"], r["grader"], r["grade"], r["source"], r["conflict"]) for r in catalog.QUERIES["resolve_grade"](spark, SF).collect())
    assert set(got) == set(want)
    for r in catalog.QUERIES["parse_card"](spark, SF).collect():
        assert (r["grader"], r["grade"]) == titles[r["title"]]
        assert (r["excluded_by"] is not None) == any(w in r["title"] for w in ("reprint", "proxy"))
