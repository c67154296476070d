"""Operators on single texts: secrets, quality, tokens, packing."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import documents, frame, words

ROWS = documents()


def test_secrets_match_the_plain_patterns(spark):
    from tidemark.llm import secrets

    extra = ['api_key: "abcdEFGH12345678" then', "AKIA" + "Q7" * 8 + " AKIAshort", "PASSWORD='short' token=abcdefabcdef0123456789", "paſſword = abcdefgh12345678 deadbeef" * 2, None]
    rows = ROWS + [(9000 + i, t, "en", "a", None) for i, t in enumerate(extra)]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(frame(spark, rows))).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r = got[doc_id]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("novel")] == [s for s in joined.split(",") if s]


def test_novelty_tells_random_strings_from_names():
    from tidemark.llm import secrets

    hit = "the client_secret is\nZq8Rk2Lw9Xv4Tn7Bm3Pc6Hd1 and goes on in prose"
    spans = secrets.find_spans(hit)
    assert [(s["kind"], hit[s["start"] : s["end"]]) for s in spans] == [("novel", "Zq8Rk2Lw9Xv4Tn7Bm3Pc6Hd1")]
    for clean in ("the bearer wrote application/json.version-1.0.0 there", "a secret of http.localhost.8080.example.com was told", "credential abcdefghijklmnopqrstuvwxyz0123456789", "no sensitive context: Zq8Rk2Lw9Xv4Tn7Bm3Pc6Hd1"):
        assert not [s for s in secrets.find_spans(clean) if s["kind"] == "novel"], clean
    assert secrets.redact_text('x token = "0123456789abcdef0123" y') == 'x [SECRET]" y'
    assert secrets.redact_text(None) is None and secrets.redact_text("") == ""


@pytest.mark.parametrize("apart", [10, 100, 385, 399, 410, 5000])
def test_repeated_keys_are_found_at_every_place(apart):
    from tidemark.llm import secrets

    rng = random.Random(apart)
    key, plain = "Zq8Rk2Lw9Xv4Tn7Bm3Pc6Hd1", "the river went on and people read of it in town ".split()
    fill = " ".join(rng.choice(plain) for _ in range(2 * apart))[: max(0, apart - 9)]
    text = f"the client id was {key} {fill} bearer {key} and so on, client_id={key}"
    want = [(m.start(), m.end()) for m in re.finditer(key, text)]
    assert [(s["start"], s["end"]) for s in secrets.find_spans(text) if s["kind"] == "novel"] == want and len(want) == 3
    assert key not in secrets.redact_text(text)


def plain_novel(text):
    """Spans by the definition: every candidate measured with the other copies of it blanked in the whole text."""
    from tidemark.llm import secrets as s

    def share(a, b):
        token = text[a:b]
        blank = text[:a].replace(token, " " * len(token))[-s.AROUND :] + text[b:].replace(token, " " * len(token))[: s.AROUND]
        size = lambda x: len(s._compressor(()).compress(x.encode("utf-8", "surrogatepass")))
        return (size(blank + token) - size(blank)) / len(token)

    found = s.candidates(text, s.known_spans(text))
    least = lambda t: s.MIN_SHARE if re.search("[0-9]", t) and re.search("[A-Za-z]", t) else s.MIN_SHARE_PLAIN
    novel = {text[a:b] for a, b in found if share(a, b) >= least(text[a:b])}
    return [(a, b) for a, b in found if text[a:b] in novel]


def test_added_spans_equal_plain_measures():
    from tidemark.llm import secrets

    rng = random.Random(8)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    names = ["application.server.config.value", "handler_of_the_request_body", "0123456789012345678901"]
    found = 0
    for _ in range(150):
        keys = ["".join(rng.choice(letters) for _ in range(rng.randint(16, 40))) for _ in range(2)] + names
        parts = []
        for _ in range(rng.randint(2, 12)):
            parts += [rng.choice(["bearer", "the secret of", "client_id=", "token", "words", "private key:", "pwd."]), rng.choice(keys), " ".join(rng.choice("on and off the wide road".split()) for _ in range(rng.randint(0, 90)))]
        text = rng.choice([" ", "\n"]).join(parts)
        got = [(s["start"], s["end"]) for s in secrets.find_spans(text) if s["kind"] == "novel"]
        assert got == plain_novel(text)
        found += len(got)
    assert found > 300


def test_secret_scan_of_long_texts_is_linear():
    import time

    from tidemark.llm import secrets

    began = time.time()
    for text in ("plain words and a token " * 200_000, "token" * 1_000_000, "bearer " + "x1" * 2_500_000, "secret " * 700_000):
        secrets.find_spans(text)
    assert time.time() - began < 60


def test_recall_of_random_keys_and_quiet_on_names():
    """99 % of random keys after sensitive words are found, and of names joined from words at most 5 % are reported."""
    import random
    import string

    from tidemark.llm import secrets

    rng = random.Random(1)
    plain = "the and config server value request host list of application name of that goes in environment".split()
    found = wrong = 0
    for _ in range(400):
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(20, 40)))
        before = " ".join(rng.choice(plain) for _ in range(60)) + rng.choice([" the client_secret is\n", " bearer ", " private key ", " credentials of it were ", " tokens "])
        text = before + key + " " + " ".join(rng.choice(plain) for _ in range(30))
        found += (len(before), len(before) + len(key)) in [(s["start"], s["end"]) for s in secrets.find_spans(text) if s["kind"] == "novel"]
        wrong += any(s["kind"] == "novel" for s in secrets.find_spans(before + "_".join(rng.choice(plain) for _ in range(4))))
    assert found >= 0.97 * 400 and wrong <= 0.05 * 400


def test_identifiers_of_the_corpus_prime_the_scan(spark):
    from tidemark.llm import secrets

    name = "quuxHandlerZvlnFactoryWbqrImpl"
    docs = spark.createDataFrame([(1, f"call {name} here"), (2, f"and {name}"), (3, None), (4, "only_once.here a1b2c3d4_key")], "doc_id long, text string")
    names = secrets.identifiers(docs)
    assert names == (name,) and secrets.identifiers(docs.limit(0)) == ()
    text = f"the secret is {name}"
    assert secrets.marginal_bytes(text, 14, len(text), names) < secrets.marginal_bytes(text, 14, len(text)) / 2


def test_quality_counts_match_brute_force(spark):
    from tidemark.llm import quality

    got = {r["doc_id"]: r for r in quality.quality(frame(spark, ROWS)).collect()}
    assert len(got) == len(ROWS)
    for doc_id, text, *_ in ROWS:
        w, t, r = words(text), text or "", got[doc_id]
        lines = [x for x in t.split("\n") if words(x)]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {x for x, n in Counter(windows).items() if n > 1}
        repeat = len({i + k for i, x in enumerate(windows) if x in twice for k in range(5)})
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), repeat), t[:80]
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["base_failed"] == (len(w) < 10 or 100 * repeat > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])


def plain_verdicts(rows):
    """class_distance, word_distance and kept of each row, with medians taken from sorted lists."""
    from tidemark.llm import quality as q

    feats = []
    for doc_id, text, lang, *_ in rows:
        t, w = text or "", words(text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {x for x, n in Counter(windows).items() if n > 1}
        repeat = len({i + k for i, x in enumerate(windows) if x in twice for k in range(5)})
        failed = len(w) < 10 or 100 * repeat > 20 * len(w)
        rest = re.sub(q.LOWER, "", t)
        counts = [len(t) - sum(map(len, w)), sum(map(len, w)) - len(rest), *(len(re.sub(x, "", rest)) for x in q.CLASSES.values())]
        shares = lambda c, n: [x / n for x in c] + [1 - sum(x / n for x in c)] if n else None
        listed = q.COMMON_WORDS.get(lang)
        feats.append((doc_id, lang if listed else "other", len(t), len(w), failed, shares(counts, len(t)), shares([w.count(x) for x in listed], len(w)) if listed else None))

    def reference(lang, at):
        held = [f[at] for f in feats if f[1] == lang and not f[4] and f[at] is not None]
        if not held:
            return None
        middle = [sorted(x)[-(-len(x) // 2) - 1] for x in zip(*held)]
        return [x / sum(middle) for x in middle]

    def distance(p, r):
        part = lambda a, b: a * np.log2(2 * a / (a + b)) if a > 0 else 0.0
        return np.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, r)) / 2))

    refs = {(lang, at): reference(lang, at) for lang in {f[1] for f in feats} for at in (5, 6)}
    out = {}
    for doc_id, lang, chars, n, failed, classes, common in feats:
        c = distance(classes, refs[lang, 5]) if chars >= q.MIN_CHARS and classes and refs[lang, 5] else None
        w = distance(common, refs[lang, 6]) if n >= q.MIN_JUDGED_WORDS and common and refs[lang, 6] else None
        out[doc_id] = (c, w, not failed and (c or 0) <= q.MAX_CLASS_DISTANCE and (w or 0) <= q.MAX_WORD_DISTANCE)
    return out


def test_quality_verdicts_match_brute_force(spark):
    from tidemark.llm import quality

    rows = [*ROWS, (70_000, ROWS[0][1].upper() * 3, "en", "a", None), (70_001, "zq! " * 200, "de", "a", None)]
    want = plain_verdicts(rows)
    got = quality.quality(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        c, w, kept = want[r["doc_id"]]
        assert r["kept"] == kept, r
        for a, b in ((r["class_distance"], c), (r["word_distance"], w)):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9)), r
    assert not all(x[2] for x in want.values()) and any(x[2] for x in want.values())
    doubled = quality.quality(frame(spark, rows + rows)).collect()
    assert len(doubled) == 2 * len(rows) and quality.quality(frame(spark, [])).count() == 0


def test_quality_finds_junk_and_keeps_prose(spark):
    from tidemark.llm import quality
    from tidemark.llm.common import table

    sf = "/root/testdata/sf0.01"
    r = quality.quality(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id")
    kept = {(x["quality"], x["base_failed"], x["kept"]): x["count"] for x in r.groupBy("quality", "base_failed", "kept").count().collect()}
    assert kept.get((1, False, False), 0) <= 0.01 * kept[1, False, True]
    assert kept.get((0, False, True), 0) <= 0.25 * kept[0, False, False]


def test_js_distance():
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tidemark.llm.quality import js_distance

    spark = SparkSession.getActiveSession()
    p, q = [0.5, 0.5, 0.0], [0.1, 0.4, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a)
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(js_distance(F.col("p"), F.col("q")).alias("d"), js_distance(F.col("p"), F.col("p")).alias("z")).first()
    assert row["d"] == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2)) and row["z"] == 0


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


TRICKY = [" lead", "trail ", "a  b", "a \n b", "a\n b", "a  b", " 　x", "it's  they'LL", "<|endoftext|> a<|endoftext|>", "ﬁ İ ΣΑΣ σας", "\x1c x\x1c y", "a\x85 b", "tab\tx \t y", "", " ", "  ", "\n"]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_gives_the_library_ids(tokenizers, name, spaced):
    from tidemark.llm.tokens import Encoder, vocabulary

    texts = [r[1] for r in ROWS] + TRICKY
    mine = list(Encoder(vocabulary(name), spaced).encode(texts, 7))
    for text, code in zip(texts, mine, strict=True):
        assert np.frombuffer(code, "<u4").tolist() == tokenizers[name].encode(text or "", add_special_tokens=False).ids + [7], repr(text)[:80]


def test_codes_round_trip(spark, tokenizers, tmp_path):
    from tidemark.llm import token_codes

    rows = ROWS + [(None, "null id", "en", "a", 7), (5, "again five", "en", "a", 10)]
    token_codes.write_codes(frame(spark, rows), str(tmp_path / "codes"))
    got = sorted(token_codes.read_codes(spark, str(tmp_path / "codes")).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    assert [r["doc_id"] for r in got] == [None] + sorted(r[0] for r in rows if r[0] is not None)
    at, texts = 0, {}
    for r in rows:
        texts.setdefault(r[0], []).append(tokenizers[token_codes.VOCABULARY].encode(r[1] or "", add_special_tokens=False).ids + [2])
    for r in got:
        assert r["start"] == at and r["ids"] in texts[r["doc_id"]]
        at += len(r["ids"])


def test_single_tokens_of_a_segment():
    from tidemark.llm import token_codes as tc

    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 256, 3000), rng.integers(0, 70000, 3000), [0, 2**32 - 1, 255, 256, 65536]]).astype("<u4")
    rng.shuffle(ids)
    names, ends, levels = tc.open_segment(tc.pack_segment([4, None], [ids[:10].tobytes(), ids[10:].tobytes()]))
    assert names == [4, None] and ends.tolist() == [10, len(ids)] and len(levels) == 4
    assert [tc.token_at(levels, i) for i in range(len(ids))] == ids.tolist()
    for a, b in ((0, 0), (0, 1), (511, 1025), (700, 6000), (len(ids) - 1, len(ids))):
        assert tc.tokens_between(levels, a, b).tolist() == ids[a:b].tolist()


def test_packing_places_every_token_once(spark, tokenizers):
    from tidemark.llm import packing

    rows = ROWS + ROWS[:3] + [(None, "null id", "en", "a", 7)]
    got = packing.pack(packing.pieces(frame(spark, rows))).collect()
    ids = {}
    for r in rows:
        ids[r[0]] = np.array(tokenizers[packing.VOCABULARY].encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
    assert sum(r["length"] for r in got) == sum(len(ids[r[0]]) for r in rows)
    bins = {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["start"] == 4096 * r["piece"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.05 * sum(r["length"] for r in got) / 4096 + 2


def test_best_fit_chooses_the_fullest_bin_that_fits():
    from tidemark.llm.packing import BestFit

    fit = BestFit(10, 2)
    assert [fit.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert fit.still_open() == []
    fit = BestFit(10, 2)
    assert [fit.put(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # bin 1, the fullest, closed
    assert sorted(fit.still_open()) == [(0, 6), (2, 8)]


def test_empty_tables(spark):
    from tidemark.llm import packing, quality, secrets, token_codes

    empty = frame(spark, [])
    assert quality.quality(empty).count() == 0
    assert secrets.digest(secrets.scan(empty)).count() == 0
    assert token_codes.encode_and_read(empty).count() == 0
    assert packing.pack(packing.pieces(empty)).count() == 0
