"""Spelling variants: each word's distance-one Levenshtein automaton, run depth-first over broadcast trie shards.

Words are the runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts with A-Z in lower case; a run whose crc32 of ``<doc_id>:<run>`` is
a multiple of ``modulus`` loses one code point, as the contract of the query asks. All letters of a word lie below 256, so words
are bytes of Latin-1 inside tasks. Tasks count before the shuffle and hand on what they hold whenever it passes HELD words.

The words that occur often enough are sorted by ranges, and every SHARD_WORDS of them (or SHARD_BYTES of letters) become one
trie: level-order arrays of labels and first children, and the words that end at nodes. So a shard's size has a fixed bound,
whatever the corpus; ROUND_BYTES of shards are broadcast at a time, and all words meet all shards round after round. In a
shard of neighbouring words, most automata of words from elsewhere die within two steps. A block of words walks the trie
together: a stack of frames, the deepest first, where a frame is (words, places in them, nodes) before or after the one edit.
A word's neighbours in a shard are counted and the best is kept where they are found; one row for each word and shard leaves
the task, never the pairs. Forms lead to words of five times the count, so chains of them are short; roots are found by
pointer doubling.

Null and empty texts have no words; a null doc_id counts as an empty text in the hash; repeated rows count each. Texts and
words count whole, however long. Ties of the best form go to the smallest word in code-point order. An empty table gives no
rows. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, sorted_unique, sql_crc32, sql_lower, stash

MODULUS, LEAST_LETTERS, LEAST_COUNT, TIMES = 199, 6, 5, 5
HELD = 200_000
SHARD_WORDS, SHARD_BYTES, ROUND_BYTES = 1 << 18, 1 << 23, 1 << 26
BLOCK_WORDS, TASK_WORDS = 2048, 16_384

#: Every byte that is no letter of a word becomes a space; A-Z become a-z.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 32 for b in range(256))


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def words_of(doc_id: int | None, text: str | None, modulus: int = MODULUS) -> Counter:
    """The words of a text as Latin-1 bytes with their counts; other characters only part them."""
    found = Counter((text or "").encode("latin-1", "replace").translate(_LETTERS).split())
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    changed = [(w, h) for w in found if not (h := zlib.crc32(_utf8(w), start)) % modulus]
    counts = [found.pop(w) for w, _ in changed]  # all go before any result comes in, which may equal one of them
    for (w, h), n in zip(changed, counts, strict=True):
        at = h % len(w)
        found[w[:at] + w[at + 1 :]] += n
    return found


def count_words(docs: DataFrame, modulus: int = MODULUS, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of all words that are long and frequent enough."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": pd.Series([w.decode("latin-1") for w in held], dtype=object), "n": np.fromiter(held.values(), np.int64, len(held))})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                for w, n in words_of(None if doc_id is pd.NA else int(doc_id), text, modulus).items():
                    if len(w) >= least_letters:
                        held[w] += n
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        yield rows()

    return docs.select("doc_id", "text").mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """A sorted list of words as level-order arrays: the children of node i are ``first[i]`` up to ``first[i + 1]``, each with its
    ``label``; ``word_at`` is the place of the word that ends at a node, or -1."""

    def __init__(self, label: np.ndarray, first: np.ndarray, word_at: np.ndarray, letters: bytes, ends: np.ndarray, counts: np.ndarray):
        self.label, self.first, self.word_at, self.letters, self.ends, self.counts = label, first, word_at, letters, ends, counts
        many = np.diff(first.astype(np.int64))
        self.keys = (np.repeat(np.arange(len(many)), many) << 8) | label[1:]  # of node i + 1: its parent and label, ascending

    @classmethod
    def of(cls, words: list[bytes], counts: list[int]) -> Trie:
        size = np.fromiter(map(len, words), np.int64, len(words))
        joined, ends = b"".join(words), np.cumsum(size)
        letters, start = np.frombuffer(joined, np.uint8), ends - size
        at, alive, made = np.zeros(len(words), np.int64), np.arange(len(words)), 1
        keys, last_nodes, last_words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for depth in range(int(size.max(initial=0))):
            alive = alive[size[alive] > depth]
            key = (at[alive] << 8) | letters[start[alive] + depth]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            at[alive] = made + np.cumsum(new) - 1
            keys.append(key[new])
            made += int(new.sum())
            last_words.append(alive[size[alive] == depth + 1])
            last_nodes.append(at[last_words[-1]])
        key = np.concatenate(keys)
        word_at = np.full(made, -1, np.int32)
        word_at[np.concatenate(last_nodes)] = np.concatenate(last_words)
        first = np.searchsorted(key, np.arange(made + 1) << 8) + 1
        return cls(np.concatenate([[0], key & 255]).astype(np.uint8), first.astype(np.uint32), word_at, joined, ends.astype(np.uint32), np.array(counts, np.int64))

    def packed(self) -> bytes:
        return pickle.dumps((self.label, self.first, self.word_at, self.letters, self.ends, self.counts))

    def word(self, i: int) -> str:
        return self.letters[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].decode("latin-1")

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by its letter, 0 for none."""
        key = (node << 8) | letter
        at = np.searchsorted(self.keys, key)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] == key[found]
        return np.where(found, at + 1, 0)

    def near(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in ``words``, place in the trie's words) of words that differ by exactly one edit, once each."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.concatenate([np.frombuffer(b"".join(words), np.uint8).astype(np.int64), [0]])
        start, pairs = np.cumsum(size) - size, [np.zeros(0, np.int64)]
        stack = [(False, np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64))]

        def push(edited: bool, w: np.ndarray, pos: np.ndarray, node: np.ndarray) -> None:
            if len(w):
                stack.append((edited, w, pos, node))

        while stack:
            edited, w, pos, node = stack.pop()
            inside = pos < size[w]
            if edited:
                done = ~inside & (self.word_at[node] >= 0)
                pairs.append(w[done] * len(self.ends) + self.word_at[node[done]])
            w_in, pos_in, node_in = w[inside], pos[inside], node[inside]
            to = self.child(node_in, letters[start[w_in] + pos_in])
            on = to > 0
            push(edited, w_in[on], pos_in[on] + 1, to[on])
            if not edited:
                push(True, w_in, pos_in + 1, node_in)  # a letter of the word is left out
                first = self.first[node].astype(np.int64)
                many = self.first[node + 1] - first
                each = np.repeat(np.arange(len(w)), many)
                child = np.arange(len(each)) + np.repeat(first - np.cumsum(many) + many, many)
                # A letter of the trie is put in before the rest of the word, or stands for the next letter.
                self._after(push, w[each], pos[each], child, size, letters, start)
                other = inside[each]
                other[other] = self.label[child[other]] != letters[start[w[each[other]]] + pos[each[other]]]
                self._after(push, w[each[other]], pos[each[other]] + 1, child[other], size, letters, start)
        found = sorted_unique(np.concatenate(pairs))
        return np.divmod(found, max(1, len(self.ends)))

    def _after(self, push, w, pos, node, size, letters, start) -> None:
        """Edited states that can go on, or are at the end: the others die here."""
        over = pos >= size[w]
        ok = over & (self.word_at[node] >= 0)
        rest = ~over
        ok[rest] = self.child(node[rest], letters[start[w[rest]] + pos[rest]]) > 0
        push(True, w[ok], pos[ok], node[ok])


def shards(words: DataFrame, n_words: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows of (shard, size, packed trie with the counts of its words), each of at most ``shard_words`` neighbouring words."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        counts: list[int] = []
        size = 0

        def row() -> pd.DataFrame:
            body = Trie.of(held, counts).packed()
            return pd.DataFrame({"size": [len(body)], "body": [body]})

        for batch in batches:
            for w, n in zip(batch["word"], batch["n"], strict=True):
                if held and (len(held) == shard_words or size + len(w) > SHARD_BYTES):
                    yield row()
                    held, counts, size = [], [], 0
                held.append(w.encode("latin-1"))
                counts.append(n)
                size += len(w)
        if held:
            yield row()

    return words.repartitionByRange(max(1, -(-n_words // shard_words)), "word").sortWithinPartitions("word").mapInPandas(build, "size long, body binary").withColumn("shard", F.monotonically_increasing_id())


def neighbours(words: DataFrame, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, n_near, and the near word of the largest count (best_n, best) of all words that have near ones."""
    spark, n_words = words.sparkSession, words.count()
    found = stash(shards(words, n_words, shard_words), "spelling-shards")
    rounds: list[list[int]] = []
    room = 0
    for r in found.select("shard", "size").orderBy("shard").toLocalIterator():  # a slim row for each shard
        if r["size"] > room:
            rounds.append([])
            room = round_bytes
        rounds[-1].append(r["shard"])
        room -= r["size"]
    dealt = words.select("word").repartition(max(1, -(-n_words // TASK_WORDS)), "word")  # Spark would read a table of these parts in few tasks
    parts = []
    for ids in rounds:
        sent = spark.sparkContext.broadcast([bytes(r["body"]) for r in found.where(F.col("shard").isin(ids)).select("body").toLocalIterator()])

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            blocks = []
            for batch in batches:
                all_words = sorted(w.encode("latin-1") for w in batch["word"])
                blocks += [all_words[i : i + BLOCK_WORDS] for i in range(0, len(all_words), BLOCK_WORDS)]
            for body in sent.value if blocks else ():
                trie = Trie(*pickle.loads(body))
                for block in blocks:
                    yield best_of(block, trie)

        parts.append(stash(dealt.mapInPandas(search, "word string, n_near long, best_n long, best string"), "spelling-near"))
        sent.destroy()
    discard(found)
    if not parts:
        return spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("best_n").alias("best_n"), F.min_by("best", F.struct(-F.col("best_n"), "best")).alias("best"))


def best_of(block: list[bytes], trie: Trie) -> pd.DataFrame:
    """A row for each word of ``block`` that has near words in the trie."""
    w, other = trie.near(block)
    order = np.lexsort((other, -trie.counts[other], w))  # the trie's words are sorted, so a smaller place is a smaller word
    w, other = w[order], other[order]
    firsts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, int)
    best = other[firsts]
    return pd.DataFrame(
        {
            "word": pd.Series([block[i].decode("latin-1") for i in w[firsts]], dtype=object),
            "n_near": np.diff(np.concatenate([firsts, [len(w)]])).astype(np.int64),
            "best_n": trie.counts[best],
            "best": pd.Series([trie.word(i) for i in best], dtype=object),
        }
    )


def roots(variants: DataFrame) -> DataFrame:
    """word and root of all words with a form, following ``form`` to the last; every step of a chain multiplies the count."""
    now = stash(variants.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        before = now
        step = before.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stash(before.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(before)
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, times: int = TIMES, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    words = stash(count_words(docs), "spelling-words")
    near = neighbours(words, shard_words, round_bytes)
    formed = F.col("best_n") >= times * F.col("n")
    found = stash(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "spelling-forms")
    return found.join(roots(found.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB SQL of the query.
ORACLE = f"""
WITH RECURSIVE per AS (SELECT doc_id, unnest(regexp_extract_all({sql_lower("text")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
each AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS keyed, count(*) AS n FROM per GROUP BY ALL),
hashed AS (SELECT run, n, {sql_crc32("keyed")} AS h FROM each),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM w, unnest(range(1, length(word) + 1)) AS t(i)),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM less a JOIN w b ON a.rest = b.word
),
best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS best_n, arg_min(other, (-o.n, other)) AS best FROM near JOIN w o ON near.other = o.word GROUP BY near.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
roots AS (SELECT walk.word, walk.root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)
"""
