"""Quality rules by distribution divergence (DataFrame operations only).

Every document gets two histograms: shares of character classes, and shares of the common words of its language. Each is
compared with the reference of that language, the median of each share over all documents of the language that pass the
base rules, by the Jensen-Shannon distance (base 2, so 0 to 1). A document is rejected if a distance is above its limit;
short documents, whose histograms are noise, are guarded by a minimum length and not judged by that distance.

Null or empty texts have no words and fail the base rules. A language that is null or has no word list here shares one
pooled reference of character classes and is not judged by common words. Repeated rows, also whole ones, count each in the
reference and are judged alike. Texts are judged whole, however long. An empty table gives no rows; where no document of a
language passes the base rules, nothing is judged by distance. Only the columns in ``keep`` come along: those of other names
can't clash, and ``keep`` must not name one of this module's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash, words

#: The most common words of each language, in order of frequency.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was"],
    "de": ["der", "die", "und", "das", "von", "ist", "in", "den", "des", "zu", "mit", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "une", "en", "que", "est", "pour"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
}
N_COMMON = 12
#: Character classes: white space, and lower-case letters with digits (numbers in prose aren't junk), then these, counted on what is left; what none covers is last.
LOWER = r"[a-z0-9ß-öø-ÿ\x20\x09-\x0D]+"
CLASSES = {"upper": r"[^A-ZÀ-ÖØ-Þ]+", "stop": r"[^.,;:'\"()-]+", "shout": r"[^!?]+", "symbol": r"[^#*$%&|<>]+"}
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Limits of the two distances, and the lengths from which they are applied.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.17, 240
MAX_WORD_DISTANCE, MIN_JUDGED_WORDS = 0.30, 80


def _repeated(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside WINDOW-word windows that occur twice or more, from the array ``w``."""
    at = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)])
    n = F.size("w")
    df = df.withColumn("h", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), at)))
    # Only documents with an equal pair of windows pay for sorting them.
    df = df.withColumn("p", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda p, j: F.get("p", j)["h"] == p["h"]
    twice = F.filter("p", lambda p, j: F.coalesce(same(p, j - 1), F.lit(False)) | F.coalesce(same(p, j + 1), F.lit(False)))
    df = df.withColumn("p", F.sort_array(F.transform(twice, lambda p: p["i"])))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("h", "p")


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Base counts and both histograms (arrays of counts) of each document."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(*[F.col(c) for c in keep], text.alias("t"), words(text).alias("w"), F.regexp_replace(text, LOWER, "").alias("rest"))
    length = lambda c: F.length(c).cast("long")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = [length(F.regexp_replace("rest", x, "")).alias(k) for k, x in CLASSES.items()]
    df = df.select(*keep, "w", F.size("w").cast("long").alias("n_words"), length(F.array_join("w", "")).alias("word_chars"), length("t").alias("chars"), length("rest").alias("n_rest"), *counts, lines.alias("lines"))
    df = df.withColumn("n_symbols", F.col("symbol")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    df = df.withColumn("classes", F.array(F.col("chars") - F.col("word_chars"), F.col("word_chars") - F.col("n_rest"), *CLASSES))
    listed = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    df = df.withColumn("list", listed[F.col("lang")])
    found = [(F.size("w") - F.size(F.array_remove("w", F.col("list")[k]))).cast("long") for k in range(N_COMMON)]
    df = df.withColumn("common", F.when(F.col("list").isNotNull(), F.array(*found)))
    df = _repeated(df.drop("lines", "list", "n_rest", *CLASSES))
    return df.drop("w").withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _shares(counts: Column, total: Column) -> Column:
    """Shares of the counted classes and of what remains; null if the total is 0."""
    some = F.transform(counts, lambda c: c / F.nullif(total, F.lit(0)))
    return F.when(total > 0, F.concat(some, F.array(F.lit(1.0) - F.aggregate(some, F.lit(0.0), lambda a, x: a + x))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as arrays of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def judge(feats: DataFrame) -> DataFrame:
    """Adds class_distance, word_distance (null: not judged) and kept."""
    df = feats.withColumn("ref_lang", F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise("other"))
    df = df.withColumn("class_shares", _shares(F.col("classes"), F.col("chars"))).withColumn("word_shares", _shares(F.col("common"), F.col("n_words")))
    # The median of each share: a mean would carry the very documents that are to be found.
    middle = lambda c, n, to: F.array(*[F.percentile_approx(F.get(c, F.lit(k)), 0.5, 1000) for k in range(n + 1)]).alias(to)
    ref = df.where(~F.col("base_failed")).groupBy("ref_lang").agg(middle("class_shares", len(CLASSES) + 2, "class_ref"), middle("word_shares", N_COMMON, "word_ref"))
    whole = lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda a, y: a + y))
    ref = ref.select("ref_lang", whole("class_ref").alias("class_ref"), whole("word_ref").alias("word_ref"))
    # One row for each listed language and one for all others, so it may be broadcast.
    df = df.join(F.broadcast(ref), "ref_lang", "left")
    df = df.withColumn("class_distance", F.when(F.col("chars") >= MIN_CHARS, js_distance(F.col("class_shares"), F.col("class_ref"))))
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= MIN_JUDGED_WORDS, js_distance(F.col("word_shares"), F.col("word_ref"))))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return df.withColumn("kept", ~F.col("base_failed") & ~far)


def quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Counts, distances and verdict of each row; the counts are written once, as the reference needs them all first."""
    return judge(stash(features(docs, keep), "quality"))
