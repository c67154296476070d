"""Secret scans: known shapes, and strings near sensitive words that zstandard can't compress.

Known shapes (kinds ``assign``, ``access``, ``hex``) are always reported. Beyond them, a string of key-like characters
that follows a sensitive word closely is a candidate. Its novelty is measured, not guessed: the marginal bytes are those
by which the compressed size grows when the candidate is added to the text around it, with a compressor primed by two
dictionaries: common words and code words (fixed), and the identifiers that the corpus itself uses most (``identifiers``).
Prose, paths, repeated names and version numbers cost a few bytes; random strings cost most of their length and are
reported as kind ``novel``. Copies of a candidate in the text around don't count against it, and equal strings fare alike.
Candidates that overlap a known shape are not reported twice.

Null texts are empty; offsets are code points, end exclusive. Texts are scanned whole and in linear time, however long
they are. Rows are scanned independently, so repeated rows give equal results and an empty table gives no rows. Spans that
start at one place are ordered by kind as listed. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import worker_cache

KINDS = ("assign", "access", "hex", "novel")
#: The patterns of the known shapes, and the least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: Words after which a string is worth measuring, within NEAR characters.
SENSITIVE = re.compile(r"(?ai:pass(?:word|wd|phrase)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|authorization|bearer|client[ _-]?id)(?ai:e?s)?(?![a-z])")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization", "bearer", "client")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
#: Between a sensitive word and its key within one run, and before a key at the start of a run.
JOINED, EQUALS = re.compile(r"[=._~-]*"), re.compile("=*")
LEAST = 16  # characters of a candidate
#: Identifiers are words joined by _ . / - or by case; they hold no digits, so keys that leak often don't become one.
IDENTIFIER = r"\b(?:[A-Za-z]{2,}(?:[_./-][A-Za-z]{2,})+|[a-z]+(?:[A-Z][a-z]+)+)\b"
MOST_IDENTIFIERS = 2000
NEAR, AROUND = 80, 400
LEVEL = 9
#: Marginal bytes for each byte of a candidate with letters and digits, and of any other: names made of letters cost more than
#: one thinks where their words are new.
MIN_SHARE, MIN_SHARE_PLAIN = 0.62, 0.9
#: Primes the compressor: keywords and words that code and its prose are made of.
COMMON = (
    "import from return class function def public static void private protected final const let var new null None true false self this "
    "string integer boolean float double list dict array object value values key keys name names index count length size type types "
    "config configuration settings options default environment variable username password secret token api_key access_key client_id "
    "client_secret authorization bearer credentials database connection host port localhost server service request response header body "
    "content-type application/json text/html utf-8 https://www.example.com/ http://localhost:8080/ /usr/local/bin /etc/ /home/user/ "
    ".json .yaml .xml .py .js .java README LICENSE version 1.0.0 2.0.0 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    "xxxxxxxxxxxxxxxxxxxxxxxx ************************ ------------------------ ======================== your_api_key_here changeme example "
    "the and that with for this was from are not have which their will would there been more about other into than only some "
)


def identifiers(docs: DataFrame) -> tuple[str, ...]:
    """The identifiers that most rows of the corpus hold (MOST_IDENTIFIERS at most, in two rows at least), rarest first.

    Counted over all rows; only the head of the list comes to the driver.
    """
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(IDENTIFIER), F.lit(0)))).alias("name"))
    top = found.groupBy("name").count().where("count > 1").orderBy(F.desc("count"), "name").limit(MOST_IDENTIFIERS)
    return tuple(r["name"] for r in reversed(top.collect()))


def _compressor(names: tuple[str, ...]) -> zstandard.ZstdCompressor:
    """One for each dictionary in a Python worker; what is last in a dictionary is the nearest and cheapest."""
    held = worker_cache("secrets")
    if names not in held:
        primer = zstandard.ZstdCompressionDict(" ".join((*names, COMMON)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primer.precompute_compress(level=LEVEL)
        held[names] = zstandard.ZstdCompressor(level=LEVEL, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)
    return held[names]


def marginal_bytes(text: str, start: int, end: int, names: tuple[str, ...] = ()) -> int:
    """Compressed bytes that text[start:end] adds to the text around it, in which its own copies are blanked.

    Copies that reach over the edge of the text around are whole in the wider cut and go before it is trimmed.
    """
    token, size = text[start:end], end - start
    before = text[max(0, start - AROUND - size) : start].replace(token, " " * size)[-AROUND:]
    after = text[end : end + AROUND + size].replace(token, " " * size)[:AROUND]
    around = (before + after).encode("utf-8", "surrogatepass")
    z = _compressor(names)
    return len(z.compress(around + token.encode())) - len(z.compress(around))


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known shapes; leftmost, non-overlapping within each kind."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


#: The runs of HEX that are long enough: a run starts where the character before it isn't of the class.
LONG_HEX = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")


def candidates(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of strings after sensitive words, apart from the known shapes.

    A run of key characters is a candidate once: from the end of the last sensitive word in it that leaves enough, or else as
    a whole, if a sensitive word ends closely before it. What joins a word to its key isn't part of the key.
    """
    low = text.lower()
    if not any(k in low for k in HINTS):
        return []
    ends = [m.end() for m in SENSITIVE.finditer(text)]
    if not ends:
        return []
    out, shape, last = [], 0, 0
    for run in CANDIDATE.finditer(text):
        start, end = run.span()
        inside = bisect_right(ends, end - LEAST) - 1
        if inside >= 0 and ends[inside] > start:
            start = JOINED.match(text, ends[inside]).end()
        elif ends[0] <= start and ends[bisect_right(ends, start) - 1] >= start - NEAR:
            start = EQUALS.match(text, start).end()
        else:
            continue
        if end - start < LEAST:
            continue
        # Known shapes come by start; ``last`` is the furthest end of those that start before this candidate's end.
        while shape < len(known) and known[shape][0] < end:
            last = max(last, known[shape][2])
            shape += 1
        if last <= start:
            out.append((start, end))
    return out


def novel_spans(text: str, known: list[tuple[int, int, int]], names: tuple[str, ...] = ()) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, marginal bytes) of incompressible candidates. Equal strings fare alike: novel at one place, novel at all."""
    measured = [(a, b, marginal_bytes(text, a, b, names)) for a, b in candidates(text, known)]
    novel = set()
    for a, b, n in measured:
        token = text[a:b]
        if n >= (MIN_SHARE if DIGIT.search(token) and LETTER.search(token) else MIN_SHARE_PLAIN) * len(token):
            novel.add(token)
    return [(a, 3, b, n) for a, b, n in measured if text[a:b] in novel]


def find_spans(text: str | None, names: tuple[str, ...] = ()) -> list[dict]:
    """All spans of a text by start and then by kind as listed: kind, start, end, and the marginal bytes of measured ones."""
    text = text or ""
    known = known_spans(text)
    spans = sorted([(*s, None) for s in known] + novel_spans(text, known, names), key=lambda s: s[:3])
    return [{"kind": KINDS[k], "start": a, "end": b, "bytes": n} for a, k, b, n in spans]


SPANS = "spans array<struct<kind string, start int, end int, bytes int>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of each row."""
    names = identifiers(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "spans": [find_spans(x, names) for x in batch["text"]]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, f"doc_id long, {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and the spans as text, with a hash of those of the known shapes."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("novel"))


def redact_text(text: str | None, mark: str = "[SECRET]", names: tuple[str, ...] = ()) -> str | None:
    """The text with every span replaced; overlapping spans are replaced together."""
    if not text:
        return text
    out, at = [], 0
    for s in find_spans(text, names):
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> Column:
    """The redacted text of each row of ``docs``."""
    names = identifiers(docs)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: redact_text(x, names=names))

    return F.pandas_udf(run, "string")("text")
