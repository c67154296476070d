"""Hierarchical Pitman-Yor language model, trained and applied to whole corpora.

A word's context is the word before it (the end token before the first). Three levels of restaurants: one for every context
word, one for each class of context words (their last two bytes, CLASSES in all), and one root, whose base is uniform over all
words and one unknown word. In a restaurant customers are tokens and dishes are words; each table of a restaurant is a
customer of its parent, so contexts share what their parents know.

Seats are drawn by Gibbs sampling. Every dish starts with a seating by the Chinese restaurant process. In a sweep, customers
are taken out one by one, each drawn from all customers of its dish, and seated again given the rest: at a table in proportion
to its customers less the discount, or at a new one in proportion to the context's weight times the parent's predictive
probability of the word. A dish of n customers makes n such moves in a sweep. Then the parents get the
tables as customers, and make their moves. As customers of one dish are alike, a dish's state is the sizes of its tables. The
dishes of a sweep are drawn in parallel, given the totals and parents' probabilities that the sweep before has left (the
usual approximation for distributed Gibbs sampling). After BURN sweeps the predictive probabilities of SAMPLES sweeps are
averaged. Discounts are estimated from counts of counts at each level; concentrations are CONCENTRATION.

How it runs. Blocks of documents ask for their distinct (word, context) pairs, with training counts. Requests are dealt by a
hash of the word; a word that is too frequent for one part (``heavy_words``) is dealt by word and class of context, which
keeps every restaurant's dish whole on the two upper levels of it that matter, and its root dish, of which there are few, is
seated by the driver. So nearly all of the model is local to a part; the totals of classes and root are arrays of fixed size,
summed over parts, and those of context words are exchanged between parts by a hash of the context. A pair that was seen
once always has one table: such dishes are counted, and only the others have a state. There are never more messages than
pairs, whatever the numbers of blocks and parts. At the end blocks ask again, the answers meet their token lists, and
documents are summed there. What is gathered (words, contexts, pairs) grows with the input and nothing is capped.

The rows are read twice, so ``docs`` must give the same rows in the same order each time, as a table does.

Null and empty texts are the end token alone; texts are taken whole, however long. A null doc_id counts as an empty text in the
hold-out rule. Repeated rows count each. With no training tokens the base is uniform. An empty table gives no rows. Columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free_shuffles, id_hash, sorted_unique, stash

BLOCK_TOKENS = 1_500_000
SLICE = 500  # texts whose words are split at once
PART_BYTES = 8 << 20  # of text for each part, so that a part's requests fit a worker whatever the input is
CLASS_BITS, CODE_BITS = 11, 40  # a context's code: a hash, and its class in the low bits
CLASSES = 1 << CLASS_BITS
BURN, SAMPLES, CONCENTRATION = 1, 2, 1.0
EVERY = 8
STEPS = 5000  # of an answer's log10, which is a whole number of them
CROWD = 1 << 16  # customers from which a dish keeps table sizes alone between sweeps
FEW = 48  # dishes that are no longer moved side by side
END = b""  # no word is empty
U64 = np.uint64
ROW = "part int, other long, kind int, body binary"
REQUEST, LIST, MODEL, CONTEXTS, TOTALS, REPLY, STATS, TABLES = range(8)


def class_of(words: list[bytes]) -> np.ndarray:
    """The class of each word as a context: six bits of its last byte, five of the one before; 0 for the end token."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end, data = np.cumsum(size), np.frombuffer(b"\0\0" + b"".join(words), np.uint8).astype(np.int64)
    return np.where(size > 0, (data[end + 1] & 63) << 5 | np.where(size > 1, data[end] & 31, 0), 0)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts (binary), A-Z in lower case, one after the other, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))  # on bytes: exactly the six white space bytes
    flat, ends = split.flatten(), np.cumsum(split.value_lengths().to_numpy())
    some = pc.binary_length(flat).to_numpy() > 0  # white space at an end of a text leaves an empty one
    so_far = np.concatenate([[0], np.cumsum(some)])
    return (flat if some.all() else flat.filter(pa.array(some))), np.diff(so_far[ends], prepend=0)


def _spread(h: np.ndarray, n: int) -> np.ndarray:
    """Numbers from 0 to n - 1 by the high bits of hashes."""
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0x9E3779B97F4A7C15)
    return (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, compressed: these bodies are what is shuffled and written."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


class Reader:
    """Takes the arrays of ``packed`` off again."""

    def __init__(self, body: bytes):
        self.body, self.at = zstandard.ZstdDecompressor().decompress(body), 0

    def take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.body, kind, n, self.at)
        self.at += out.nbytes
        return out


def _codes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes in five bytes each."""
    return (code & 0xFFFFFFFF).astype("<u4"), (code >> 32).astype("u1")


def _read_codes(r: Reader, n: int) -> np.ndarray:
    return r.take("<u4", n).astype(np.int64) | r.take("u1", n).astype(np.int64) << 32


def dumped(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays of whole numbers by name; those that never fall as differences, and all in as few bytes as they need."""
    out, kept = io.BytesIO(), {}
    for k, x in arrays.items():
        x = np.asarray(x).astype(np.int64)
        if len(x) and x[0] >= 0 and (np.diff(x) >= 0).all():
            k, x = f"{k}+", np.diff(x, prepend=0)
        kept[k] = x.astype(np.min_scalar_type(x.max())) if len(x) and x.min() >= 0 else x
    np.savez(out, **kept)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def loaded(body: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(body))) as z:
        return {k.removesuffix("+"): np.cumsum(z[k], dtype=np.int64) if k.endswith("+") else z[k].astype(np.int64) for k in z.files}


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "other", "kind", "body"])


# --- Blocks of documents


class Block:
    """Documents on their way into one block."""

    def __init__(self):
        self.words, self.lengths, self.doc_ids, self.held, self.n = [], [], [], [], 0

    def add(self, doc_id: int | None, text: bytes | None, held: bool) -> None:
        self.extend([doc_id], *words_of(pa.array([text], pa.binary())), [held])

    def extend(self, doc_ids: list, words: pa.Array, lengths: np.ndarray, held: list) -> None:
        """Adds documents by their words, one after the other; each ends with the end token."""
        self.words.append(words)
        self.lengths.append(lengths + 1)
        self.doc_ids += doc_ids
        self.held += held
        self.n += len(words) + len(lengths)

    def coded(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct words, the end token first; the tokens as places among them; tokens of each document."""
        lengths = np.concatenate(self.lengths)
        found = pa.concat_arrays(self.words).dictionary_encode()
        self.words = []
        tokens, words = np.zeros(self.n, np.int32), np.ones(self.n, bool)
        words[np.cumsum(lengths) - 1] = False
        tokens[words] = found.indices.to_numpy() + 1
        return [END, *found.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)], tokens, lengths

    def rows(self, block: int, parts: int, heavy: np.ndarray, lists: bool) -> Iterator[tuple[int, int, int, bytes]]:
        """A request for each part that has pairs, and (``lists``) the token lists."""
        words, tokens, lengths = self.coded()
        size = len(words)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U64, size)
        code = ((_mix(hashes) >> U64(64 - CODE_BITS + CLASS_BITS)).astype(np.int64) << CLASS_BITS) | class_of(words)
        # Words are named by the order of their hashes, contexts by that of their codes, so pairs sort as their parts do.
        by_hash, by_code = np.argsort(hashes), np.argsort(code)
        as_word, as_context = np.empty(size, np.int64), np.empty(size, np.int64)
        as_word[by_hash], as_context[by_code] = np.arange(size), np.arange(size)
        key = as_word[tokens] * size
        key[0] += as_context[0]  # a document ends with the end token, which is the first word's context
        key[1:] += as_context[tokens[:-1]]
        del tokens
        train = key[~np.repeat(np.array(self.held), lengths)]
        pairs, pair = np.unique(key, return_inverse=True) if lists else (sorted_unique(key), None)
        counts = np.zeros(len(pairs), "<u4")
        train = np.sort(train)
        del key
        starts = np.flatnonzero(np.concatenate([[True], train[1:] != train[:-1]])) if len(train) else np.zeros(0, np.int64)
        counts[np.searchsorted(pairs, train[starts])] = np.diff(np.append(starts, len(train)))
        del train
        h, code = hashes[by_hash][pairs // size], code[by_code][pairs % size]
        part, order = _spread(h, parts), None
        if len(heavy) and (often := heavy[np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)] == h).any():
            part[often] = _spread(_mix(h[often] ^ (code[often] & (CLASSES - 1)).astype(U64) * U64(0x94D049BB133111EB)), parts)
            order = np.argsort(part, kind="stable")
            h, code, counts, part = h[order], code[order], counts[order], part[order]
        ends = np.searchsorted(part, np.arange(parts), side="right")
        first = 0
        for p in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            last = int(ends[p])
            new = np.flatnonzero(np.concatenate([[True], h[first + 1 : last] != h[first : last - 1]]))
            each = np.diff(np.append(new, last - first)).astype("<u4")
            yield p, block, REQUEST, packed(np.array([len(new), last - first], "<u4"), h[first:last][new].astype("<u8"), each, *_codes(code[first:last]), counts[first:last])
            first = last
        if lists:
            if order is not None:
                place = np.empty(len(pairs), np.int64)
                place[order] = np.arange(len(pairs))
                pair = place[pair]
            # A document's pairs in ascending order, as differences: most take two bytes.
            pair = np.sort(np.repeat(np.arange(len(lengths)) * len(pairs), lengths) + pair) % len(pairs)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            gaps = np.diff(pair, prepend=0)
            gaps[starts] = pair[starts]
            wide = gaps[gaps >= 0xFFFF].astype("<u4")
            ids = np.array([0 if x is None else x for x in self.doc_ids], "<i8")
            null = np.array([x is None for x in self.doc_ids], np.uint8)
            head = np.array([len(ids), len(pair), len(wide)], "<u4")
            yield block % parts, block, LIST, packed(head, ids, null, np.array(self.held, np.uint8), lengths.astype("<u4"), *_bytes(np.minimum(gaps, 0xFFFF)), wide)


def _bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 65536 as their low and their high bytes, which compress better apart."""
    return (x & 0xFF).astype("u1"), (x >> 8).astype("u1")


def _with_held(docs: DataFrame) -> DataFrame:
    held = (F.pmod(id_hash(F.col("doc_id")), F.lit(10)) == 0).alias("held")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), held)


def blocks_of(docs: DataFrame, parts: int, heavy: np.ndarray, lists: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq, held = TaskContext.get().partitionId() << 24, 0, Block()

        def full() -> pa.RecordBatch:
            part, other, kind, body = zip(*held.rows(base + seq, parts, heavy, lists), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(other, pa.int64()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], ["part", "other", "kind", "body"])

        for batch in (whole.slice(first, SLICE) for whole in batches for first in range(0, whole.num_rows, SLICE)):
            words, lengths = words_of(batch["text"])
            doc_ids, out = batch["doc_id"].to_pylist(), batch["held"].to_pylist()
            ends, at = np.cumsum(lengths), 0
            while at < len(lengths):
                before = int(ends[at - 1]) if at else 0
                # Up to the document that makes the block full.
                n = min(len(lengths), at + 1 + int(np.searchsorted(np.cumsum(lengths[at:] + 1), BLOCK_TOKENS - held.n)))
                held.extend(doc_ids[at:n], words.slice(before, int(ends[n - 1]) - before), lengths[at:n], out[at:n])
                at = n
                if held.n >= BLOCK_TOKENS:
                    yield full()
                    seq, held = seq + 1, Block()
        if held.n:
            yield full()

    return _with_held(docs).mapInArrow(run, ROW)


def heavy_words(docs: DataFrame, parts: int) -> np.ndarray:
    """Hashes of the words with at least half a part's share of all tokens: at most twice as many as parts.

    They decide where pairs are dealt, not what comes out, so every EVERY-th run of rows is enough to find them. Such a word has
    half of that share in some run of documents at least, so only those are counted beyond a task.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for at in range(0, len(batch), 500 * EVERY):
                found.update(b" ".join(x for x in batch["text"].iloc[at : at + 500] if x).lower().split())
                if found.total() >= BLOCK_TOKENS:
                    yield often(found)
                    found = Counter()
        yield often(found)

    def often(found: Counter) -> pd.DataFrame:
        n = found.total()
        some = [(xxhash.xxh3_64_intdigest(w) - (1 << 63), k) for w, k in found.items() if 4 * parts * k >= n]
        return pd.DataFrame([(None, n), *some], columns=["word", "n"]).astype({"word": "Int64"})

    by = stash(docs.select(F.col("text").cast("binary")).mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "hpy-heavy")
    total = by.where("word IS NULL").first()["n"] if not by.isEmpty() else 0
    found = by.where((F.col("word").isNotNull()) & (F.col("n") * 2 * parts >= total)).select("word").collect()
    discard(by)
    return np.sort(np.array([r["word"] + (1 << 63) for r in found], U64))


# --- Seatings


class Seating:
    """The customers of many dishes, each at a table; customers of one dish are alike.

    Flat arrays: dish i has the places at[i] to at[i + 1]; ``table`` has the table of each of its customers, and a table is named
    by a place, where ``size`` has its customers. ``free`` has the names that aren't in use, as a stack.
    """

    def __init__(self, tables: np.ndarray, sizes: np.ndarray, room: np.ndarray, rng: np.random.Generator):
        self.rng, self.t = rng, tables.astype(np.int64)
        owner = np.repeat(np.arange(len(tables)), self.t)
        self.c = np.bincount(owner, sizes, len(tables)).astype(np.int64)
        self.room = np.maximum(room, self.c)
        self.at = np.concatenate([[0], np.cumsum(self.room)])[:-1].astype(np.int64)
        n = int(self.room.sum())
        self.size, self.table, self.free = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        k = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(self.t)])[:-1], self.t)
        names = self.at[owner] + k
        self.size[names] = sizes
        seats = np.repeat(names, sizes)
        of = np.repeat(owner, sizes)
        self.table[self.at[of] + np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(self.c)])[:-1], self.c)] = seats
        spare = self.room - self.t
        of = np.repeat(np.arange(len(tables)), spare)
        k = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(spare)])[:-1], spare)
        self.free[self.at[of] + k] = self.at[of] + self.t[of] + k

    def add(self, d: np.ndarray, n: np.ndarray | None, odds: np.ndarray, discount: float) -> None:
        """Seat ``n`` more customers (one) of each of the dishes ``d``, all given who sits there now."""
        each = d if n is None else np.repeat(d, n)
        rank = 0 if n is None else np.arange(len(each)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
        c, t, at = self.c[each], self.t[each], self.at[each]
        o = odds[each]
        new = self.rng.random(len(each)) * (o + c - discount * t) < o
        seat = np.empty(len(each), np.int64)
        i = np.flatnonzero(new)
        if n is None:
            nth = 0
        else:
            so_far = np.cumsum(new)
            nth = so_far[i] - 1 - np.repeat(np.concatenate([[0], so_far[np.cumsum(n) - 1]])[:-1], n)[i]
        seat[i] = self.free[at[i] + self.room[each[i]] - t[i] - 1 - nth]
        todo = np.flatnonzero(~new)
        while len(todo):  # the table of any customer, in proportion to its customers; kept in proportion to those less the discount
            table = self.table[at[todo] + (self.rng.random(len(todo)) * c[todo]).astype(np.int64)]
            fine = self.rng.random(len(todo)) * self.size[table] >= discount
            seat[todo[fine]] = table[fine]
            todo = todo[~fine]
        self.table[at + c + rank] = seat
        if n is None:
            self.size[seat] += 1
            self.c[d] += 1
            self.t[each[i]] += 1
        else:
            np.add.at(self.size, seat, 1)
            self.c[d] += n
            np.add.at(self.t, each[i], 1)

    def remove(self, d: np.ndarray) -> None:
        """Take a customer, any of them, out of each of the dishes ``d``."""
        at, c = self.at[d], self.c[d]
        place = at + (self.rng.random(len(d)) * c).astype(np.int64)
        table = self.table[place]
        self.table[place] = self.table[at + c - 1]
        self.c[d] -= 1
        self.size[table] -= 1
        empty = self.size[table] == 0
        e = d[empty]
        self.free[self.at[e] + self.room[e] - self.t[e]] = table[empty]
        self.t[e] -= 1

    def bring_to(self, goal: np.ndarray, odds: np.ndarray, discount: float) -> None:
        """Customers come or go until each dish has ``goal``; many come in runs of a sixteenth of those seated."""
        while len(d := np.flatnonzero(self.c > goal)):
            self.remove(d)
        while len(d := np.flatnonzero(self.c < goal)):
            self.add(d, np.minimum(goal[d] - self.c[d], np.maximum(1, self.c[d] // 16)), odds, discount)

    def sweep(self, odds: np.ndarray, discount: float) -> None:
        """As many moves of each dish as it has customers: side by side while there are many such dishes, then each of the largest."""
        moves = np.where(self.c > 1, self.c, 0)
        order = np.argsort(-moves, kind="stable")
        moves = moves[order]
        # In this order the dishes that still move are the first ones, and their figures are slices.
        c, t, at, o = moves, self.t[order], self.at[order], odds[order]
        spare, others = at + self.room[order] - 1, c - 1
        for step in range(int(moves[0]) if len(moves) else 0):
            n = int(np.searchsorted(-moves, -step, side="left"))
            if n < FEW:
                self.t[order] = t
                for k in range(n):
                    self.finish(order[k], int(moves[k]) - step, float(o[k]), discount)
                return
            self.move(c[:n], t[:n], at[:n], spare[:n], others[:n], o[:n], discount)
        self.t[order] = t

    def move(self, c: np.ndarray, t: np.ndarray, at: np.ndarray, spare: np.ndarray, others: np.ndarray, odds: np.ndarray, discount: float) -> None:
        """A customer, any of them, of each of some dishes leaves its table and is seated again; ``t`` is kept up to date."""
        u = self.rng.random((4, len(c)))
        i = (u[0] * c).astype(np.int64)
        place = at + i
        table = self.table.take(place)
        left = self.size[table] - 1
        self.size[table] = left
        e = np.flatnonzero(left == 0)
        if len(e):
            self.free[spare[e] + 1 - t[e]] = table[e]
            t[e] -= 1
        new = u[1] * (odds + others - discount * t) < odds
        k = np.flatnonzero(new)
        seat = np.empty(len(c), np.int64)
        seat[k] = self.free[spare[k] - t[k]]
        # The table of any other customer, kept in proportion to its customers less the discount.
        todo = np.flatnonzero(~new)
        j = (u[2][todo] * others[todo]).astype(np.int64)
        keep = u[3][todo]
        while len(todo):
            table = self.table.take(at.take(todo) + j + (j >= i.take(todo)))
            fine = keep * self.size[table] >= discount
            seat[todo[fine]] = table[fine]
            todo = todo[~fine]
            j, keep = (self.rng.random(len(todo)) * others[todo]).astype(np.int64), self.rng.random(len(todo))
        self.table[place] = seat
        self.size[seat] += 1
        t[k] += 1

    def finish(self, i: int, moves: int, odds: float, discount: float) -> None:
        """The last moves of a dish; of its seats only the table sizes are kept."""
        at = self.at[i]
        names, seats = np.unique(self.table[at : at + self.c[i]], return_inverse=True)
        sizes = moved(seats, self.size[names], moves, odds, discount, self.rng)
        self.size[at : at + self.room[i]] = 0
        self.size[at : at + len(sizes)] = sizes
        self.t[i] = len(sizes)

    def sizes(self) -> np.ndarray:
        """Table sizes, dish after dish."""
        return self.size[self.size > 0]


def moved(seats: np.ndarray, sizes: np.ndarray, moves: int, odds: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Table sizes of one dish after so many moves; ``seats`` has the table of each customer."""
    at, size, free, others, t = seats.tolist(), sizes.tolist(), [], len(seats) - 1, len(sizes)

    def draws() -> Iterator[float]:
        while True:
            yield from rng.random(1 << 12).tolist()

    draw, bulk = draws().__next__, 1 << 13
    for first in range(0, moves, bulk):
        u = rng.random((4, min(bulk, moves - first)))
        leaves, other = (u[0] * (others + 1)).astype(np.int64), (u[1] * others).astype(np.int64)
        other += other >= leaves
        for i, j, x, keep in zip(leaves.tolist(), other.tolist(), u[2].tolist(), u[3].tolist(), strict=True):
            table = at[i]
            size[table] -= 1
            if not size[table]:
                free.append(table)
                t -= 1
            if x * (odds + others - discount * t) < odds:
                if not free:
                    free.append(len(size))
                    size.append(0)
                table = free.pop()
                t += 1
                at[i] = table
            else:
                table = at[j]
                while keep * size[table] < discount:  # the table of any other customer, kept in proportion to its customers less the discount
                    j, keep = int(draw() * others), draw()
                    table = at[j + (j >= i)]
                at[i] = table
            size[table] += 1
    return np.array([n for n in size if n], np.int64)


def crowd(sizes: np.ndarray, goal: int, odds: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Table sizes of one dish of very many customers after they are brought to ``goal`` and have made a sweep's moves."""
    sizes, c = sizes.astype(np.int64), int(sizes.sum())
    while c < goal:
        n = min(goal - c, max(1, c // 16))
        new = int(rng.binomial(n, odds / (odds + c - discount * len(sizes)))) if c else 1
        if n > new:
            sizes = sizes + rng.multinomial(n - new, (sizes - discount) / (c - discount * len(sizes)))
        sizes, c = np.concatenate([sizes, np.ones(new, np.int64)]), c + max(n, new)
    if c > goal:
        sizes = rng.multivariate_hypergeometric(sizes, goal, method="marginals")
        sizes, c = sizes[sizes > 0], goal
    return moved(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), sizes, c if c > 1 else 0, odds, discount, rng)


SMALL = 3  # customers of a dish that its number of tables tells all of


def small(tables: np.ndarray, customers: np.ndarray, goal: np.ndarray, odds: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of at most SMALL customers after they are brought to ``goal`` and have made a sweep's moves.

    Such a dish has at most one table of more than one customer, so its number of tables is its whole state.
    """
    t, c = tables.copy(), customers.copy()

    def leave(d: np.ndarray) -> None:  # a customer, any of them
        alone = np.where(t[d] == 1, c[d] == 1, t[d] - (t[d] < c[d]))  # customers alone at a table
        t[d] -= rng.random(len(d)) * c[d] < alone
        c[d] -= 1

    def come(d: np.ndarray) -> None:
        t[d] += rng.random(len(d)) * (odds[d] + c[d] - discount * t[d]) < odds[d]
        c[d] += 1

    while len(d := np.flatnonzero(c > goal)):
        leave(d)
    while len(d := np.flatnonzero(c < goal)):
        come(d)
    for step in range(SMALL):
        d = np.flatnonzero((c > 1) & (c > step))
        leave(d)
        come(d)
    return t


def seated(tables: np.ndarray, sizes: np.ndarray, goal: np.ndarray, odds: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables and table sizes of each dish after its customers are brought to ``goal`` and have made a sweep's moves."""
    large = np.flatnonzero(goal > CROWD)
    ends = np.cumsum(tables)
    customers = np.bincount(np.repeat(np.arange(len(tables)), tables), sizes, len(tables)).astype(np.int64)
    few = np.maximum(customers, goal) <= SMALL
    if few.any():
        rest = seated(tables[~few], sizes[np.repeat(~few, tables)], goal[~few], odds[~few], discount, rng) if not few.all() else (tables[:0], sizes[:0])
        t = np.empty(len(goal), np.int64)
        t[few], t[~few] = small(tables[few], customers[few], goal[few], odds[few], discount, rng), rest[0]
        out = np.ones(int(t.sum()), np.int64)
        out[np.repeat(~few, t)] = rest[1]
        first = np.cumsum(t) - t
        here = few & (t > 0)
        out[first[here]] = goal[here] - t[here] + 1  # the others have one customer each
        return t, out
    if not len(large):
        s = Seating(tables, sizes, goal, rng)
        s.bring_to(goal, odds, discount)
        s.sweep(odds, discount)
        return s.t, s.sizes()
    some = goal <= CROWD
    found = seated(tables[some], sizes[np.repeat(some, tables)], goal[some], odds[some], discount, rng)
    parts = np.split(found[1], np.cumsum(found[0])[:-1]) if len(found[0]) else []
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(goal)
    for i, x in zip(np.flatnonzero(some), parts, strict=True):
        out[i] = x
    for i in large:
        out[i] = crowd(sizes[ends[i] - tables[i] : ends[i]], int(goal[i]), float(odds[i]), discount, rng)
    return np.array([len(x) for x in out], np.int64), np.concatenate(out)


# --- One part of the model


class Merged:
    """All requests of one part: distinct words and (word, context) pairs with training counts, by word hash and code."""

    def __init__(self, bodies: list[bytes], heavy: np.ndarray):
        hashes, each, code, counts = [], [], [], []
        for body in bodies:
            r = Reader(body)
            n_words, n_pairs = map(int, r.take("<u4", 2))
            hashes.append(r.take("<u8", n_words))
            each.append(r.take("<u4", n_words))
            code.append(_read_codes(r, n_pairs))
            counts.append(r.take("<u4", n_pairs))
        self.each, self.sizes = each, [(len(h), len(c)) for h, c in zip(hashes, code, strict=True)]
        self.words, self.word_of_request = np.unique(np.concatenate(hashes), return_inverse=True)
        self.codes, context = np.unique(np.concatenate(code), return_inverse=True)
        pairs, self.pair = np.unique(np.repeat(self.word_of_request, np.concatenate(each)) * len(self.codes) + context, return_inverse=True)
        self.n2 = np.bincount(self.pair, np.concatenate(counts), len(pairs)).astype(np.int64)
        self.w2, self.c2 = pairs // len(self.codes), pairs % len(self.codes)
        # The level above: (word, class).
        above, self.up = np.unique(self.w2 * CLASSES + (self.codes[self.c2] & (CLASSES - 1)), return_inverse=True)
        self.w1, self.class1 = above // CLASSES, above % CLASSES
        self.count = np.bincount(self.w2, self.n2, len(self.words)).astype(np.int64)
        self.heavy = np.full(len(self.words), -1)
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, self.words), len(heavy) - 1)
            self.heavy = np.where(heavy[at] == self.words, at, -1)
        # Pairs seen once have one table for good, and so has a dish above with one such pair alone.
        self.moving2 = self.n2 > 1
        self.once1 = np.bincount(self.up, self.n2 == 1, len(above)).astype(np.int64)
        self.moving1 = (self.once1 > 1) | (np.bincount(self.up, self.moving2, len(above)) > 0)
        self.once0 = np.bincount(self.w1, ~self.moving1 & (self.once1 == 1), len(self.words)).astype(np.int64)
        self.moving0 = (self.once0 > 1) | (np.bincount(self.w1, self.moving1, len(self.words)) > 0)

    def model(self) -> dict[str, np.ndarray]:
        """What moves, by places among the moving; no dish has a table yet."""
        place1, place0 = np.cumsum(self.moving1) - 1, np.cumsum(self.moving0) - 1
        used, context = np.unique(self.c2[self.moving2], return_inverse=True)
        none = np.zeros(0, np.int64)
        out = {"up2": place1[self.up[self.moving2]], "context": context, "n2": self.n2[self.moving2], "codes": self.codes[used]}
        out |= {"up1": place0[self.w1[self.moving1]], "class1": self.class1[self.moving1], "once1": self.once1[self.moving1]}
        out |= {"once0": self.once0[self.moving0], "heavy": self.heavy[self.moving0]}
        for level, n in ((2, len(out["up2"])), (1, len(out["up1"])), (0, len(out["once0"]))):
            out |= {f"tables{level}": np.zeros(n, np.int64), f"sizes{level}": none}
        return out

    def stats(self, n_heavy: int) -> np.ndarray:
        """Sums for the whole corpus: dishes of classes that never move, tokens, words, root dishes that never move, counts of
        counts, tokens of heavy words, their dishes that never move."""
        light = self.heavy < 0
        types1 = np.bincount(self.up, self.n2 > 0, len(self.w1))
        types0 = np.bincount(self.w1, types1 > 0, len(self.words))
        twice = [float((x == k).sum()) for x in (self.n2, types1, types0[light]) for k in (1, 2)]
        still = ~self.moving1 & (self.once1 == 1)
        of_heavy = np.bincount(self.heavy[~light], self.count[~light], n_heavy)
        once = ((~self.moving0) & (self.once0 == 1) & light).sum()
        alone = np.bincount(self.heavy[~light], self.once0[~light] * ~self.moving0[~light], n_heavy)
        return np.concatenate([np.bincount(self.class1[still], minlength=CLASSES), [self.n2.sum(), ((self.count > 0) & light).sum(), once], twice, of_heavy, alone])

    def contexts(self, parts: int) -> Iterator[tuple[int, bytes]]:
        """For the part of each context: codes, customers, dishes seen once and all dishes here, and which move here."""
        customers = np.bincount(self.c2, self.n2, len(self.codes)).astype("<u4")
        once, kinds = (np.bincount(self.c2, x, len(self.codes)).astype("<u4") for x in (self.n2 == 1, self.n2 > 0))
        for other, at in by_part(self.codes, parts):
            yield other, packed(np.array([len(at)], "<u4"), *_codes(self.codes[at]), customers[at], once[at], kinds[at])


def by_part(codes: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, places) of the contexts that each part keeps; places in the order of the codes."""
    where = _spread(_mix(codes.astype(U64)), parts)
    order = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.diff(where[order])) + 1
    return [(int(where[at[0]]), at) for at in np.split(order, cuts)] if len(order) else []


class Corpus:
    """The sums of ``Merged.stats`` over all parts, and the totals that the last sweep left."""

    def __init__(self, s: np.ndarray, n_heavy: int):
        self.still = s[:CLASSES]
        self.tokens, self.words, self.once = s[CLASSES : CLASSES + 3]
        ones = s[CLASSES + 3 : CLASSES + 9].reshape(3, 2)
        # Of context words, classes and the root.
        self.discounts = [min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5 for a, b in ones]
        self.of_heavy, self.alone = s[CLASSES + 9 : CLASSES + 9 + n_heavy], s[CLASSES + 9 + n_heavy :]
        self.words += (self.of_heavy > 0).sum()
        self.uniform = 1 / (self.words + 1)
        self.customers, self.tables, self.tables0 = self.still + 1, self.still + 1, max(1.0, self.words)
        self.heavy_n = self.heavy_t = np.maximum(0, np.minimum(1, self.of_heavy)).astype(np.int64)
        self.state = (np.zeros(n_heavy, np.int64), np.zeros(0, np.int64))

    def after(self, s: np.ndarray, rng: np.random.Generator) -> Corpus:
        """The corpus with the totals of a sweep; the root's dishes of heavy words are seated here."""
        out = object.__new__(Corpus)
        out.__dict__ |= self.__dict__
        out.customers, out.tables = s[:CLASSES] + self.still, s[CLASSES : 2 * CLASSES] + self.still
        out.heavy_n = (s[2 * CLASSES + 1 :] + self.alone).round().astype(np.int64)
        odds = np.full(len(out.heavy_n), (CONCENTRATION + self.discounts[2] * self.tables0) * self.uniform)
        out.state = seated(*self.state, out.heavy_n, odds, self.discounts[2], rng)
        out.heavy_t = out.state[0]
        out.tables0 = s[2 * CLASSES] + self.once + out.heavy_t.sum()
        return out

    def p0(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The root's predictive probability of dishes with n customers at t tables."""
        d = self.discounts[2]
        return (n - d * t + (CONCENTRATION + d * self.tables0) * self.uniform) / (CONCENTRATION + self.tables.sum())

    def p1(self, n: np.ndarray, t: np.ndarray, of: np.ndarray, p0: np.ndarray) -> np.ndarray:
        d = self.discounts[1]
        return (n - d * t + (CONCENTRATION + d * self.tables[of]) * p0) / (CONCENTRATION + self.customers[of])


def counts_of(m: dict[str, np.ndarray], corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Customers and tables of the moving dishes of classes and of the root."""
    n1 = m["once1"] + np.bincount(m["up2"], m["tables2"], len(m["once1"])).astype(np.int64)
    n0 = m["once0"] + np.bincount(m["up1"], m["tables1"], len(m["once0"])).astype(np.int64)
    often = m["heavy"] >= 0
    n0, t0 = n0.copy(), m["tables0"].copy()
    n0[often], t0[often] = corpus.heavy_n[m["heavy"][often]], corpus.heavy_t[m["heavy"][often]]
    return n1, m["tables1"], n0, t0


def sweep(m: dict[str, np.ndarray], totals: np.ndarray, corpus: Corpus, seed: tuple[int, ...]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The model after a sweep, and its share of the totals. ``totals``: tables of the contexts that move, as they were."""
    rng = np.random.default_rng(seed)
    d2, d1, d0 = corpus.discounts
    n1, t1, n0, t0 = counts_of(m, corpus)
    p0 = corpus.p0(n0, t0)
    p1 = corpus.p1(n1, t1, m["class1"], p0[m["up1"]])
    out = dict(m)
    out["tables2"], out["sizes2"] = seated(m["tables2"], m["sizes2"], m["n2"], (CONCENTRATION + d2 * totals[m["context"]]) * p1[m["up2"]], d2, rng)
    n1 = counts_of(out, corpus)[0]
    out["tables1"], out["sizes1"] = seated(m["tables1"], m["sizes1"], n1, (CONCENTRATION + d1 * corpus.tables[m["class1"]]) * p0[m["up1"]], d1, rng)
    n0 = m["once0"] + np.bincount(m["up1"], out["tables1"], len(m["once0"])).astype(np.int64)
    light = m["heavy"] < 0
    # Heavy words have no table here.
    odds = np.full(len(n0), (CONCENTRATION + d0 * corpus.tables0) * corpus.uniform)
    out["tables0"], out["sizes0"] = seated(m["tables0"], m["sizes0"], np.where(light, n0, 0), odds, d0, rng)
    n_heavy = len(corpus.of_heavy)
    stats = [np.bincount(m["class1"], n1, CLASSES), np.bincount(m["class1"], out["tables1"], CLASSES), [out["tables0"].sum()], np.bincount(m["heavy"][~light], n0[~light], n_heavy)]
    return out, np.concatenate(stats)


def predict(g: Merged, models: list[dict[str, np.ndarray]], customers: np.ndarray, tables: list[np.ndarray], corpora: list[Corpus]) -> np.ndarray:
    """log10 of the averaged predictive probability of each pair; customers and tables (of each sample): of its contexts."""
    mean = np.zeros(len(g.n2))
    for m, of, corpus in zip(models, tables, corpora, strict=True):
        full = lambda moving, still, values: _filled(moving, still, values)
        t2 = full(g.moving2, (g.n2 == 1).astype(np.int64), m["tables2"])
        n1 = g.once1 + np.bincount(g.up, t2 * g.moving2, len(g.once1)).astype(np.int64)
        t1 = full(g.moving1, np.minimum(g.once1, 1), m["tables1"])
        n0 = np.bincount(g.w1, t1, len(g.words)).astype(np.int64)
        t0 = full(g.moving0, np.minimum(g.once0, 1), m["tables0"])
        often = g.heavy >= 0
        n0[often], t0[often] = corpus.heavy_n[g.heavy[often]], corpus.heavy_t[g.heavy[often]]
        p1 = corpus.p1(n1, t1, g.class1, corpus.p0(n0, t0)[g.w1])
        d2 = corpus.discounts[0]
        mean += (g.n2 - d2 * t2 + (CONCENTRATION + d2 * of[g.c2]) * p1[g.up]) / (CONCENTRATION + customers[g.c2])
    return np.log10(mean / len(models))


def _filled(moving: np.ndarray, still: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = still.copy()
    out[moving] = values
    return out


# --- The exchange of context totals


def answer_totals(group: pd.DataFrame, samples: int, all_contexts: bool) -> pd.DataFrame:
    """Answers to the parts that ask one part for the totals of contexts, in the order of their codes.

    CONTEXTS rows have what never moves, TOTALS rows (``other`` part, sample by row order) the tables of moving contexts.
    """
    first = [(r.part, Reader(r.body)) for r in group[group["kind"] == CONTEXTS].sort_values("part").itertuples()]
    found = []
    for part, r in first:
        (n,) = map(int, r.take("<u4", 1))
        found.append((part, _read_codes(r, n), r.take("<u4", n), r.take("<u4", n), r.take("<u4", n)))
    codes, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(x[1] for x in found)]), return_inverse=True)
    add = lambda k: np.bincount(at, np.concatenate([x[k] for x in found]), len(codes)) if found else np.zeros(0)
    customers, once, kinds = add(2), add(3), add(4)
    moving = []
    for s in range(samples):
        tables = once.copy()
        for r in group[group["kind"] == TOTALS + 10 * (s + 1)].itertuples():
            b = Reader(r.body)
            (n,) = map(int, b.take("<u4", 1))
            np.add.at(tables, np.searchsorted(codes, _read_codes(b, n)), b.take("<u4", n))
        moving.append(tables)
    out, start = [], 0
    for part, own, *_ in found:
        i = at[start : start + len(own)]
        start += len(own)
        body = [customers[i], *(x[i] for x in moving)] if all_contexts else [once[i], kinds[i]]
        out.append((part, int(group["other"].iloc[0]), REPLY, packed(np.array([len(own)], "<u4"), *(x.astype("<u4") for x in body))))
    return _rows(out)


def _sum_totals(group: pd.DataFrame) -> pd.DataFrame:
    """Tables of moving contexts, summed over the parts that hold them."""
    asked = []
    for r in group.sort_values("part").itertuples():
        b = Reader(r.body)
        (n,) = map(int, b.take("<u4", 1))
        asked.append((r.part, _read_codes(b, n), b.take("<u4", n)))
    codes, at = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True)
    total = np.bincount(at, np.concatenate([x[2] for x in asked]), len(codes)).astype("<u4")
    out, start = [], 0
    for part, own, _ in asked:
        out.append((part, int(group["other"].iloc[0]), REPLY, packed(np.array([len(own)], "<u4"), total[at[start : start + len(own)]])))
        start += len(own)
    return _rows(out)


def _replies(group: pd.DataFrame, codes: np.ndarray, parts: int, columns: int) -> list[np.ndarray]:
    """Columns of the replies, in the order of the codes."""
    out = [np.zeros(len(codes)) for _ in range(columns)]
    bodies = {r.other: r.body for r in group[group["kind"] == REPLY].itertuples()}
    for other, at in by_part(codes, parts):
        r = Reader(bodies[other])
        (n,) = map(int, r.take("<u4", 1))
        for column in out:
            column[at] = r.take("<u4", n)
    return out


# --- The whole


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = [np.frombuffer(x, float) for batch in batches for x in batch["body"]]
    if found:
        yield pd.DataFrame({"body": [np.sum(found, axis=0).tobytes()]})


def _sum_stats(rows: DataFrame) -> np.ndarray:
    """Sum of the STATS arrays: some tasks add theirs, and the driver adds those."""
    found = rows.where(F.col("kind") == STATS).select("body").mapInPandas(_added, "body binary").repartition(8).mapInPandas(_added, "body binary").collect()
    return np.sum([np.frombuffer(r["body"], float) for r in found], axis=0)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if docs.isEmpty():
        return spark.createDataFrame([], schema)
    heavy = heavy_words(docs, parts)
    n_heavy = len(heavy)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        g = Merged(group.sort_values("other")["body"].tolist(), heavy)
        m = g.model()
        out = [(part, 0, MODEL, dumped(m)), (part, 0, STATS, g.stats(n_heavy).tobytes())]
        out += [(part, other, CONTEXTS, body) for other, body in g.contexts(parts)]
        return _rows(out)

    built = stash(blocks_of(docs, parts, heavy, False).groupBy("part").applyInPandas(build, ROW), "hpy-built")
    free_shuffles(spark)
    corpus = Corpus(_sum_stats(built), n_heavy)
    contexts = built.where(F.col("kind") == CONTEXTS)
    # A part needs the totals of the contexts that move in it; they are among those that it asked for.
    still = stash(contexts.groupBy("other").applyInPandas(lambda group: answer_totals(group, 0, False), ROW), "hpy-still")

    def start(group: pd.DataFrame) -> pd.DataFrame:
        """The model with what never moves of its contexts' totals."""
        part = int(group["part"].iloc[0])
        m = loaded(group.loc[group["kind"] == MODEL, "body"].iloc[0])
        asked = [Reader(x) for x in group[group["kind"] == CONTEXTS].sort_values("other")["body"]]
        codes = np.concatenate([_read_codes(r, int(r.take("<u4", 1)[0])) for r in asked])
        codes.sort()
        at = np.searchsorted(codes, m["codes"])
        once, kinds = (x[at] for x in _replies(group, codes, parts, 2))
        return _rows([(part, 0, MODEL, dumped(m | {"once2": once, "totals": kinds}))])

    model = stash(built.where(F.col("kind").isin(MODEL, CONTEXTS)).union(still).groupBy("part").applyInPandas(start, ROW), "hpy-model")
    discard(still)
    free_shuffles(spark)

    def run_sweep(corpus: Corpus, n: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            part = int(group["part"].iloc[0])
            m = loaded(group.loc[group["kind"] == MODEL, "body"].iloc[0])
            totals = m["once2"] + _replies(group, m["codes"], parts, 1)[0] if n else m["totals"]
            m, stats = sweep(m, totals, corpus, (part, n))
            here = np.bincount(m["context"], m["tables2"], len(m["codes"])).astype("<u4")
            out = [(part, 0, STATS, stats.tobytes())]
            if n < BURN + SAMPLES - 1:
                out.append((part, 0, MODEL, dumped(m)))
            if n >= BURN:
                out.append((part, 0, TABLES, dumped({f"tables{level}": m[f"tables{level}"] for level in range(3)})))
            for other, at in by_part(m["codes"], parts):
                out.append((part, other, TOTALS, packed(np.array([len(at)], "<u4"), *_codes(m["codes"][at]), here[at])))
            return _rows(out)

        return run

    samples, corpora, replies = [], [], None
    for n in range(BURN + SAMPLES):
        rows = model.where(F.col("kind") == MODEL)
        swept = stash((rows.union(replies) if replies is not None else rows).groupBy("part").applyInPandas(run_sweep(corpus, n), ROW), "hpy-sweep")
        corpus = corpus.after(_sum_stats(swept), np.random.default_rng(n))
        if replies is not None:
            discard(replies)
            replies = None
        if n <= BURN:
            discard(model)
        if n >= BURN:
            samples.append(swept)
            corpora.append(corpus)
        if n < BURN + SAMPLES - 1:
            replies = stash(swept.where(F.col("kind") == TOTALS).groupBy("other").applyInPandas(_sum_totals, ROW), "hpy-totals")
        model = swept
        free_shuffles(spark)
    discard(*([replies] if replies is not None else []))
    n_samples = len(samples)
    asked = contexts
    for k, s in enumerate(samples):
        asked = asked.union(s.where(F.col("kind") == TOTALS).withColumn("kind", F.lit(TOTALS + 10 * (k + 1))))
    known = stash(asked.groupBy("other").applyInPandas(lambda group: answer_totals(group, n_samples, True), ROW), "hpy-known")
    tables = None
    for k, s in enumerate(samples):
        rows = s.where(F.col("kind") == TABLES).withColumn("kind", F.lit(TABLES + 10 * (k + 1)))
        tables = rows if tables is None else tables.union(rows)
    tables = stash(tables, "hpy-tables")
    discard(built, *samples)
    free_shuffles(spark)
    last = blocks_of(docs, parts, heavy, True).union(known).union(tables)
    of_heavy = corpus.of_heavy

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        lists = group[group["kind"] == LIST]
        out = [(-1, r.other, LIST, r.body) for r in lists.itertuples()]
        requests = group[group["kind"] == REQUEST].sort_values("other")
        if len(requests):
            g = Merged(requests["body"].tolist(), heavy)
            models = [loaded(group.loc[group["kind"] == TABLES + 10 * (k + 1), "body"].iloc[0]) for k in range(n_samples)]
            customers, *tables = _replies(group, g.codes, parts, 1 + n_samples)
            logs = np.clip(np.round(-STEPS * predict(g, models, customers, tables, corpora)), 0, 0xFFFF).astype(np.int64)[g.pair]
            count = np.where(g.heavy >= 0, np.append(of_heavy, 0)[g.heavy], g.count)[g.word_of_request].astype("<u8")
            w = p = 0
            for block, (n_words, n_pairs), each in zip(requests["other"], g.sizes, g.each, strict=True):
                out.append((part, block, REQUEST, packed(np.array([n_words, n_pairs], "<u4"), count[w : w + n_words], each, *_bytes(logs[p : p + n_pairs]))))
                w, p = w + n_words, p + n_pairs
        return _rows(out)

    answered = last.groupBy("part").applyInPandas(answer, ROW)
    n, v = corpus.tokens, corpus.words

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        logs, counts = [], []
        for body in group["body"].iloc[1:]:
            r = Reader(body)
            n_words, n_pairs = map(int, r.take("<u4", 2))
            known, each = r.take("<u8", n_words), r.take("<u4", n_words)
            counts.append(np.repeat(known, each))
            logs.append(r.take("u1", n_pairs) + 256.0 * r.take("u1", n_pairs))
        logs, counts = np.concatenate(logs) / -STEPS, np.concatenate(counts).astype(float)
        r = Reader(group["body"].iloc[0])
        n_docs, n_tokens, n_wide = map(int, r.take("<u4", 3))
        ids, null, held = r.take("<i8", n_docs), r.take("u1", n_docs).astype(bool), r.take("u1", n_docs).astype(bool)
        lengths = r.take("<u4", n_docs).astype(np.int64)
        gaps = r.take("u1", n_tokens) + 256 * r.take("u1", n_tokens).astype(np.int64)
        gaps[gaps == 0xFFFF] = r.take("<u4", n_wide)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        run = np.cumsum(gaps)
        pair = run - np.repeat(run[starts] - gaps[starts], lengths)
        c = counts[pair]
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        return pd.DataFrame(
            {
                "doc_id": pd.array(np.where(null, 0, ids), "Int64"),
                "held_out": held,
                "n_tokens": lengths,
                "n_known": np.add.reduceat(c > 0, starts, dtype=np.int64),
                "train_tokens": int(n),
                "base_score": np.add.reduceat(base, starts),
                "score": np.add.reduceat(logs[pair], starts),
            }
        ).assign(doc_id=lambda x: x["doc_id"].mask(null))

    return answered.groupBy("other").applyInPandas(finish, schema)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity by token of the held-out and of the training documents, of the model and of the base."""
    by = scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("s"), F.sum("base_score").alias("b"))
    return by.select("held_out", "n_tokens", F.pow(F.lit(10.0), -F.col("s") / F.col("n_tokens")).alias("perplexity"), F.pow(F.lit(10.0), -F.col("b") / F.col("n_tokens")).alias("base_perplexity"))
