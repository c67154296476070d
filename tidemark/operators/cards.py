"""Listings read as cards: grades from title and description, attributes and evidence, grades recovered from descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parsing import Lexicon, edition_of, evidence_of, grade_of, markers, parsed_card, resolved_grade, series_of
from tidemark.plans.register import query
from tidemark.sources.views import market, titled

#: What the stand-in titles have in place of the domain's words.
LEXICON = Lexicon(excluded=("reprint", "proxy"), era_words=("standard", "economy"), not_followed={"standard": (" anodized",)}, codes=("BR1-JP",), era=(1994, 1996), outside=((1997, 1999),))


def described(rows: DataFrame) -> DataFrame:
    """``titled`` with a seller's description: none, one grade, a heap of search words, doubt, or authenticity only."""
    d = F.col("quantity") % 6
    text = (
        F.when(d == 0, F.concat_ws("\n", "title", F.lit("as in the pictures")))
        .when(d == 1, F.concat(F.lit("it is PSA"), F.col("grade").cast("string"), F.lit(" and clean<br>ships fast")))
        .when(d == 2, F.concat(F.lit("BGS"), F.col("grade").cast("string"), F.lit("\nsearch words PSA10 PSA9 ARS10")))
        .when(d == 3, "authenticity only")
        .when(d == 4, "PSA 8 or PSA 9, I am not sure")
    )
    return titled(rows).withColumn("description", text)


@query(None)
def resolve_grade(spark, sf_dir):
    """Grade, its source and the reason of each listing (look-arounds have no form in the other engine's patterns)."""
    df = described(market(spark, sf_dir)).select("key", "title", "description").distinct()
    return df.select("key", resolved_grade(F.col("title"), F.col("description")).alias("g")).select("key", "g.*")


@query(None)
def parse_card(spark, sf_dir):
    """All attributes of each title; excluded titles keep theirs."""
    df = titled(market(spark, sf_dir)).select("title").distinct()
    return df.select("title", parsed_card(F.col("title"), LEXICON).alias("c")).select("title", "c.*")


@query(
    """WITH d AS (SELECT DISTINCT key, quantity % 7 <> 0 AS known, grade, quantity % 6 AS d FROM market), g AS (SELECT *, NOT known AND d = 1 OR NOT known AND d = 2 AS recovered FROM d)
SELECT known AS had_grade, recovered, count(*) AS n, CAST(sum(CASE WHEN recovered THEN grade END) AS DOUBLE) AS grades FROM g WHERE NOT known GROUP BY known, recovered""",
    "market",
)
def grade_recovery(spark, sf_dir):
    """Listings without a grade in the title whose description is read again: how many get one, before and after."""
    df = described(market(spark, sf_dir)).select("key", "title", "description").distinct()
    df = df.withColumn("before", grade_of(F.col("title"))["grade"]).where("before IS NULL")
    df = df.withColumn("after", resolved_grade(F.col("title"), F.col("description"))["grade"])
    return df.groupBy(F.col("before").isNotNull().alias("had_grade"), F.col("after").isNotNull().alias("recovered")).agg(F.count("*").alias("n"), F.sum("after").alias("grades"))


@query(
    "SELECT array_to_string(list_filter([CASE WHEN regexp_matches(title, '(?i)promo') THEN 'promo' END, CASE WHEN regexp_matches(title, '(?i)(polished|burnished)') THEN 'modern' END, CASE WHEN regexp_matches(title, '(?i)re-?print') THEN 'reprint' END], lambda x: x IS NOT NULL), ',') AS marks, count(*) AS n FROM (SELECT DISTINCT title FROM titled) GROUP BY marks",
    "titled",
)
def variant_markers(spark, sf_dir):
    """Which variant marks a title carries."""
    marks = markers(F.col("title"), {"promo": "(?i)promo", "modern": "(?i)(polished|burnished)", "reprint": "(?i)re-?print"})
    df = titled(market(spark, sf_dir)).select("title").distinct()
    return df.groupBy(F.array_join(marks, ",").alias("marks")).agg(F.count("*").alias("n"))


@query(
    "SELECT CASE WHEN regexp_matches(title, '(?i)1st *ed(ition)?') THEN 'first' WHEN regexp_matches(title, '(?i)limited|限定') THEN 'limited' END AS edition, nullif(regexp_extract(regexp_extract(title, '([A-Z0-9]+-JP[0-9]{4})', 1), '^([A-Z]+[0-9]?)-', 1), '') AS series, count(*) AS n FROM (SELECT DISTINCT title FROM titled) GROUP BY ALL",
    "titled",
)
def edition_and_series(spark, sf_dir):
    """Edition words and the letters of the set code."""
    df = titled(market(spark, sf_dir)).select("title").distinct()
    code = F.regexp_extract("title", "([A-Z0-9]+-JP[0-9]{4})", 1)
    return df.groupBy(edition_of(F.col("title")).alias("edition"), series_of(code).alias("series")).agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT DISTINCT title FROM titled), e AS (SELECT title, CASE WHEN contains(upper(title), 'REPRINT') OR contains(upper(title), 'PROXY') THEN 'excluded' WHEN contains(replace(upper(title), 'STANDARD ANODIZED', ''), 'STANDARD') OR contains(upper(title), 'ECONOMY') THEN 'era_word' ELSE 'none' END AS hit FROM t)
SELECT hit, count(*) AS n FROM e GROUP BY hit""",
    "titled",
)
def keyword_evidence(spark, sf_dir):
    """Words that exclude a title or prove its era, place by place: a word followed by its anti-suffix is no proof."""
    df = titled(market(spark, sf_dir)).select("title").distinct().select(evidence_of(F.col("title"), LEXICON).alias("c"))
    hit = F.when(F.col("c.excluded_by").isNotNull(), "excluded").when(F.exists("c.era_evidence", lambda x: x.startswith("word:")), "era_word").otherwise("none")
    return df.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))
