"""Names in titles: the name that starts first, of those the longest, with aliases and guards for short keys.

A dictionary of bounded size (MAX_KEYS keys of MAX_LETTERS characters, both counted first) becomes one automaton of all keys, a trie
with failure links, that each Python worker builds once and runs over Arrow batches: a title is read once, however many
keys there are. A larger dictionary is joined instead: a key is anchored by its first characters, as many as the largest power of
two in it, so a title gives a few pieces for each of its places, and those that meet an anchor are compared with whole keys. Both
give the same rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import folded
from tidemark.plans.register import query
from tidemark.sources.shared import kept
from tidemark.sources.views import market, table, titled

MAX_KEYS, MAX_LETTERS = 200_000, 8_000_000
MIN_KEY, MIN_ASCII_KEY = 2, 6

#: The words of which one must follow a name of one character (rarities, graders, periods).
CONFIRMING = (
    "スーパー ウルトラ シークレット レリーフ アルティメット パラレル ノーマル レア シク "
    "PSA ARS BGS "
    "初期 一期 1期 二期 2期 三期 3期"
).split()

_RUBY = "<ruby>(.*?)<rt>(.*?)</rt></ruby>"


# --- Keys


def keys_of(names: DataFrame) -> DataFrame:
    """key, name and listed of a dictionary (name, aliases array, listed).

    A name's readings in ruby marks are taken off; if the whole name has one reading, and no hiragana is in it, the reading
    is an alias. Keys are folded as titles are. A key of one character counts only if it isn't ASCII (and is confirmed where it is
    found), one of ASCII letters and digits from MIN_ASCII_KEY characters on. A key of several names is that of a listed one,
    and of the least of those.
    """
    bare = F.regexp_replace("name", _RUBY, "$1")
    reading = F.regexp_extract("name", f"^{_RUBY}$", 2)
    alias = F.when((reading != "") & ~F.col("name").rlike("</ruby>.+") & ~reading.rlike("[ぁ-ゖ]"), reading)
    every = F.array_compact(F.concat(F.array(bare, alias), F.coalesce("aliases", F.array().cast("array<string>"))))
    keys = names.where("name IS NOT NULL").select(bare.alias("name"), "listed", F.explode(every).alias("key")).withColumn("key", folded(F.col("key")))
    size, plain = F.length("key"), F.col("key").rlike("^[a-z0-9]*$")
    usable = F.when(size < MIN_KEY, (size == 1) & ~F.col("key").rlike("^[\\x00-\\x7F]$")).otherwise(~plain | (size >= MIN_ASCII_KEY))
    first = F.min(F.struct((~F.col("listed")).alias("late"), "name"))
    return keys.where(usable).groupBy("key").agg(first.alias("first")).select("key", "first.name", (~F.col("first.late")).alias("listed"))


# --- Confirmation of short keys


def confirmed(title: str | None, singles: frozenset[str]) -> list[str]:
    """Names of one character that begin a word of the title and are followed by a confirming word, at once or as the next word."""
    found = set()
    words = re.findall(r"\w+", unicodedata.normalize("NFKC", title or "").lower())
    for word, after in zip(words, [*words[1:], ""], strict=False):
        if word[0] in singles and (word[1:] or after).startswith(_CONFIRMING):
            found.add(word[0])
    return sorted(found)


_CONFIRMING = tuple(w.lower() for w in CONFIRMING)

# --- The automaton

_built: dict[int, ahocorasick.Automaton] = {}


def automaton(keys: list[str]) -> ahocorasick.Automaton:
    """Built once for each list of keys in a worker."""
    at = hash(tuple(keys))
    if at not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for i, key in enumerate(keys):
            made.add_word(key, (len(key), i))
        made.make_automaton()
        _built[at] = made
    return _built[at]


def earliest_longest(found: ahocorasick.Automaton, longest: int, text: str, keys: list[str], singles: list[str]) -> int:
    """The place of the winning key, -1 for none. The search ends where no later key can start earlier."""
    start, size, best = len(text), 0, -1
    for end, (n, i) in found.iter(text):
        if end - longest + 1 > start:
            break
        at = end - n + 1
        if (at < start or at == start and n > size) and (n > 1 or keys[i] in singles):
            start, size, best = at, n, i
    return best


def _by_automaton(titles: DataFrame, keys: list[str]) -> DataFrame:
    longest = max(map(len, keys), default=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = automaton(keys)
        for batch in batches:
            best = [earliest_longest(found, longest, t, keys, s) for t, s in zip(batch["folded"], batch["singles"], strict=True)]
            hit = [i for i, b in enumerate(best) if b >= 0]
            yield pd.DataFrame({"title": batch["title"].iloc[hit].astype(object), "key": pd.Series([keys[best[i]] for i in hit], dtype=object).to_numpy()})

    return titles.mapInPandas(run, "title string, key string") if keys else titles.select("title", F.lit(None).cast("string").alias("key")).limit(0)


# --- The join


def _by_anchors(titles: DataFrame, keys: DataFrame) -> DataFrame:
    width = lambda n: F.pow(F.lit(2), F.floor(F.log2(n))).cast("int")
    anchored = keys.select("key", F.length("key").alias("size")).withColumn("width", width(F.col("size"))).withColumn("anchor", F.substring("key", F.lit(1), F.col("width")))
    widths = anchored.agg(F.array_sort(F.collect_set("width")).alias("widths"))  # one row, of some twenty widths
    pieces = titles.crossJoin(F.broadcast(widths)).select("title", "folded", "singles", F.explode("widths").alias("width")).where(F.length("folded") >= F.col("width"))
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(1), F.length("folded") - F.col("width") + 1)).alias("at"))
    pieces = pieces.withColumn("anchor", F.substring("folded", F.col("at"), F.col("width")))
    met = pieces.join(anchored, ["width", "anchor"]).where(F.substring("folded", F.col("at"), F.col("size")) == F.col("key"))
    met = met.where((F.col("size") > 1) | F.array_contains("singles", F.col("key")))
    return met.groupBy("title").agg(F.max_by("key", F.struct(-F.col("at"), F.col("size"))).alias("key"))


def matched(titles: DataFrame, keys: DataFrame, fold: bool = True, max_keys: int = MAX_KEYS) -> DataFrame:
    """title and key of all distinct titles in which some key of ``keys`` is found; ``fold`` folds titles first."""
    size = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("letters"), F.array_sort(F.collect_set(F.when(F.length("key") == 1, F.col("key")))).alias("singles")).first()
    singles = frozenset(size["singles"]) if fold else frozenset()  # single characters: bounded by the alphabet

    @F.pandas_udf("array<string>")
    def confirmed_in(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: confirmed(t, singles))

    rows = titles.select("title").where("title IS NOT NULL").distinct()
    rows = rows.withColumn("folded", folded(F.col("title")) if fold else F.col("title")).withColumn("singles", confirmed_in("title") if singles else F.array().cast("array<string>") if fold else F.lit(size["singles"]))
    if size["n"] <= max_keys and size["letters"] <= MAX_LETTERS:
        return _by_automaton(rows, [r["key"] for r in keys.select("key").orderBy("key").collect()])
    return _by_anchors(rows, keys)


def longest_match(titles: DataFrame, names: DataFrame) -> DataFrame:
    """Titles with the name that starts first in them, the longest of those; names are found as they are, inside words as well."""
    keys = names.where("name IS NOT NULL AND name <> ''").select(F.col("name").alias("key")).distinct()
    return matched(titles, keys, fold=False).withColumnRenamed("key", "name")


def with_longest_match(rows: DataFrame, names: DataFrame, title: str = "title", to: str = "name", max_keys: int = MAX_KEYS) -> DataFrame:
    """``rows`` with what ``longest_match`` finds in their titles, and null for nothing.

    By the automaton rows are read where they are: titles are neither made distinct nor joined back.
    """
    keys = names.where("name IS NOT NULL AND name <> ''").select(F.col("name").alias("key")).distinct()
    keys = kept(keys, "keys")
    size = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("letters")).first()
    if size["n"] > max_keys or size["letters"] > MAX_LETTERS:
        rows = kept(rows, "titled")
        found = matched(rows.select(F.col(title).alias("title")), keys, fold=False, max_keys=max_keys).select(F.col("title").alias(title), F.col("key").alias(to))
        return rows.join(found, title, "left")
    every = [r["key"] for r in keys.orderBy("key").collect()]
    longest, singles = max(map(len, every), default=0), [k for k in every if len(k) == 1]

    @F.pandas_udf("string")
    def name_in(titles: pd.Series) -> pd.Series:
        found, known = automaton(every), {}
        for t in titles:
            if t is not None and t not in known:
                best = earliest_longest(found, longest, t, every, singles)
                known[t] = every[best] if best >= 0 else None
        return pd.Series([known.get(t) for t in titles], dtype=object)

    return rows.withColumn(to, name_in(title) if every else F.lit(None).cast("string"))


# --- Queries


def _dictionary(spark, sf_dir) -> DataFrame:
    """Names of parts; the words in reverse, and each word alone, are aliases; those that begin with ``new`` or ``old`` aren't listed."""
    words = F.split("p_name", " ")
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("name"), F.array(F.concat_ws(" ", words[1], words[0]), words[0], words[1]).alias("aliases"), (~words[0].isin("new", "old")).alias("listed"))


_FOLD = "lower(regexp_replace({0}, '[^a-zA-Z0-9]', '', 'g'))"


@query(
    f"""WITH n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), k AS (SELECT name, a NOT IN ('new', 'old') AS listed, {_FOLD.format('unnest([name, b || a, a, b])')} AS key FROM n),
d AS (SELECT key, arg_min(name, (NOT listed, name)) AS name, bool_or(listed) AS listed FROM k WHERE length(key) >= {MIN_ASCII_KEY} GROUP BY key), t AS (SELECT DISTINCT title, {_FOLD.format('title')} AS folded FROM titled),
m AS (SELECT title, arg_max(key, -instr(folded, key) * 1000 + length(key)) AS key FROM t JOIN d ON contains(folded, key) GROUP BY title)
SELECT title, key, name, listed FROM m JOIN d USING (key)""",
    "titled",
)
def dictionary_alias_match(spark, sf_dir):
    """Titles by names and aliases, folded alike, without keys that are too short to tell."""
    keys = keys_of(_dictionary(spark, sf_dir))
    return matched(titled(market(spark, sf_dir)), keys).join(keys, "key").select("title", "key", "name", "listed")
