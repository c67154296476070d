"""Names in titles against brute force: aliases, readings, short keys, both forms."""

import random
import unicodedata

import pytest

NAMES = [
    ("<ruby>青眼の白龍<rt>ブルーアイズ・ホワイト・ドラゴン</rt></ruby>", None, True),
    ("<ruby>山<rt>やま</rt></ruby>", None, True),
    ("海", [], True),
    ("７", None, True),
    ("Dark Lake", ["lake of dark", "Lake"], True),
    ("Dark Lake Queen", None, False),
    ("dark-lake", None, False),
    ("Mirror Wall", ["mirror", "鏡の壁"], True),
    ("<ruby>炎<rt>ほのお</rt></ruby>の<ruby>剣<rt>けん</rt></ruby>", None, True),
    (None, ["ghost"], True),
]


def fold(t):
    t = "".join(c for c in unicodedata.normalize("NFKC", t).lower() if unicodedata.category(c)[0] not in "PSZC")
    return "".join(chr(ord(c) - 96) if 0x30A1 <= ord(c) <= 0x30F6 else c for c in t)


def expected_keys():
    """Written out: the key, its owner and whether it is listed."""
    return {
        fold("青眼の白龍"): ("青眼の白龍", True),
        fold("ブルーアイズ・ホワイト・ドラゴン"): ("青眼の白龍", True),
        "山": ("山", True),
        "海": ("海", True),
        "darklake": ("Dark Lake", True),
        "lakeofdark": ("Dark Lake", True),
        "darklakequeen": ("Dark Lake Queen", False),
        "mirrorwall": ("Mirror Wall", True),
        "mirror": ("Mirror Wall", True),
        fold("鏡の壁"): ("Mirror Wall", True),
        fold("炎の剣"): ("炎の剣", True),
    }


def frames(spark):
    return spark.createDataFrame(NAMES, "name string, aliases array<string>, listed boolean")


def test_keys(spark):
    from tidemark.operators.dictionary import keys_of

    assert {r["key"]: (r["name"], r["listed"]) for r in keys_of(frames(spark)).collect()} == expected_keys()


def plain(title, keys, confirm):
    f = fold(title)
    for at in range(len(f)):
        here = [k for k in keys if f.startswith(k, at) and (len(k) > 1 or k in confirm)]
        if here:
            return max(here, key=len)
    return None


TITLES = {
    # title: characters that are confirmed names in it
    "遊戯王 山 スーパーレア PSA9": "山",
    "岡山 スーパー": "",
    "神秘なる山 PSA 10": "",
    "山(レリーフ)": "山",
    "山 の 海 初期": "海",
    "海馬 PSA": "",
    "海PSA10": "海",
    "海": "",
    "7 PSA": "",
    "ブルーアイズ ホワイト ドラゴン レリーフ": "",
    "the DARK-LAKE Queen, dark lake": "",
    "Queen of Dark Lakes": "",
    "a lake": "",
    "mirror mirror wall": "",
    "炎の剣 鏡の壁": "",
    "": "",
    "nothing here": "",
}


@pytest.mark.parametrize("max_keys", [10**6, 0])
def test_titles_equal_brute_force(spark, max_keys):
    from tidemark.operators.dictionary import confirmed, keys_of, matched

    rng = random.Random(4)
    bits = ["dark", "lake", "queen", "mirror", "wall", "of", "山", "海", "レア", "psa", "の", "剣", "炎", "-", " "]
    more = {"".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(300)}
    singles = frozenset("山海")
    for title, want in TITLES.items():
        assert confirmed(title, singles) == sorted(want), title
    keys = keys_of(frames(spark))
    got = {r["title"]: r["key"] for r in matched(spark.createDataFrame([(t,) for t in [*TITLES, *more, None, "海PSA10"]], "title string"), keys, max_keys=max_keys).collect()}
    want = {t: plain(t, expected_keys(), TITLES[t] if t in TITLES else confirmed(t, singles)) for t in [*TITLES, *more]}
    assert got == {t: k for t, k in want.items() if k} and len(got) > 100


def test_an_empty_dictionary_matches_nothing(spark):
    from tidemark.operators.dictionary import keys_of, matched

    titles = spark.createDataFrame([("Dark Lake",)], "title string")
    assert matched(titles, keys_of(frames(spark).limit(0))).count() == 0
    assert matched(titles.limit(0), keys_of(frames(spark))).count() == 0


def test_anchors_equal_the_automaton_on_plain_names(spark):
    from tidemark.operators.dictionary import matched

    rng = random.Random(9)
    names = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(40)}
    titles = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(200)}
    t, k = spark.createDataFrame([(x,) for x in titles], "title string"), spark.createDataFrame([(x,) for x in names], "key string")
    one, two = ({(r["title"], r["key"]) for r in matched(t, k, fold=False, max_keys=m).collect()} for m in (10**6, 0))
    assert one == two and len(one) > 50
