"""The source protocol, its registry, reports and settings."""

import json
import pathlib

import pytest

from tidemark.functions.settings import Settings, load
from tidemark.sources import scans

SF = "/root/testdata/sf0.001"


def test_sources_by_name(spark):
    asia = scans.source("asia", spark, SF)
    every = asia.search("")
    assert every.count() == every.where("site = 'ASIA' AND basis = 'ask'").count() > 0
    word = every.first()["title"].split()[0]
    cheap = asia.search(word, max_price=1500.0)
    assert cheap.count() == every.where(f"instr(lower(title), lower('{word}')) > 0 AND price <= 1500").count()
    assert asia.search("", pages=1).count() == min(scans.PAGE_ROWS, every.count())
    assert asia.search_detailed(word).health == "ok" and asia.search_detailed("no such title").health == "empty"
    assert asia.search("", sold=True).where("basis <> 'sold'").isEmpty()
    with pytest.raises(ValueError):
        scans.source("africa", spark, SF).search("", sold=True)
    with pytest.raises(KeyError):
        scans.source("nowhere", spark, SF)
    with pytest.raises(ValueError):
        scans.register("asia", lambda spark, sf_dir: asia)


def test_report_is_replaced(spark, tmp_path):
    for n in (3, 2):
        scans.write_report(spark.range(n).toDF("id"), str(tmp_path / "report"))
    lines = [json.loads(x) for f in pathlib.Path(tmp_path / "report").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["id"] for x in lines) == [0, 1]


def test_settings_never_get_looser():
    with pytest.warns(UserWarning) as said:
        got = load({"min_peers": 5, "shrink": "4", "margin": 0.01, "coverage": float("nan"), "capacity": 3.5, "other": 1, "min_cell": True})
    assert got == Settings(min_peers=5) and len(said) == 6
    assert load({}) == Settings()


def market_rows(spark):
    from tidemark.sources.views import market, titled

    return titled(market(spark, SF))


def test_feed_gives_the_rows_of_the_market(spark, tmp_path):
    from tidemark.sources import feed

    folder = str(tmp_path / "feed")
    rows = market_rows(spark)
    feed.publish(rows, folder, page_rows=500)
    got = feed.feed(spark, folder)
    names = sorted(rows.columns)
    assert sorted(got.columns) == names and len(feed.pages(folder)) > 10
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, rows.select(names).collect()))
    by_table, by_feed = scans.MarketSource(spark, SF, "ASIA"), scans.FeedSource(spark, folder, "ASIA")
    for search in ({"keyword": ""}, {"keyword": "PSA", "max_price": 1200.0}, {"keyword": "", "sold": True, "pages": 1}):
        assert sorted(r["key"] for r in by_feed.search(**search).collect()) == sorted(r["key"] for r in by_table.search(**search).collect())
    assert by_feed.search_detailed("no such title").health == "empty"


def test_feed_takes_filters_and_leaves_out_pages(spark, tmp_path, capsys):
    from pyspark.sql.datasource import IsNull

    from tidemark.sources import feed

    folder = str(tmp_path / "feed")
    rows = market_rows(spark)
    feed.publish(rows, folder, page_rows=500)
    reader = feed.MarketReader(folder)
    left = list(reader.pushFilters([feed.EqualTo(("site",), "ASIA"), feed.In(("basis",), ("sold", None)), feed.LessThan(("price",), 1200.0), IsNull(("grade",))]))
    assert left == [IsNull(("grade",))]  # Spark applies it
    assert 0 < len(reader.partitions()) < len(feed.pages(folder)) / 3
    assert {(p.values()["site"], p.values()["basis"]) for p in reader.partitions()} == {("ASIA", "sold")}
    df = feed.feed(spark, folder).where("site = 'ASIA' AND price < 1200 AND seller IN (1, 2, 3, 5, 8) AND title LIKE '%PSA%' AND quantity % 2 = 0")
    df.explain("formatted")
    plan = capsys.readouterr().out
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "site" in pushed and "price" in pushed and "seller" in pushed
    want = rows.where("site = 'ASIA' AND price < 1200 AND seller IN (1, 2, 3, 5, 8) AND title LIKE '%PSA%' AND quantity % 2 = 0")
    assert sorted(r["key"] for r in df.collect()) == sorted(r["key"] for r in want.collect())


def test_feed_as_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.sources import feed

    folder, out, state = (str(tmp_path / x) for x in ("feed", "out", "state"))
    rows = market_rows(spark)
    feed.enable(spark)
    sizes = []
    for batch in range(3):
        feed.publish(rows.where(F.abs(F.xxhash64("key")) % 3 == batch), folder, batch, page_rows=400)
        for _ in range(2):  # the second run finds nothing new
            spark.readStream.format(feed.FORMAT).load(folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
            sizes.append(spark.read.parquet(out).count())
    assert sizes[0] == sizes[1] < sizes[2] == sizes[3] < sizes[4] == sizes[5] == rows.count()
    assert spark.read.parquet(out).select("key").distinct().count() == rows.select("key").distinct().count()


def test_feed_without_pages(spark, tmp_path):
    from tidemark.sources import feed

    feed.publish(market_rows(spark).limit(0), str(tmp_path / "feed"))
    assert feed.feed(spark, str(tmp_path / "feed")).count() == 0
    assert feed.pages(str(tmp_path / "none")) == []
