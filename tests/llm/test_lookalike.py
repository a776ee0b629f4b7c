"""Look-alike classes against brute force over all pairs, by a plain normal form."""

from __future__ import annotations

import itertools
import random
import unicodedata

from leafstream.llm import lookalike

PARTS = "part_id bigint, translation string"
CHUNKS = "chunk_id bigint, texts array<string>"
LATIN, FA, RU = "The house of Norven kept 2314 letters", "خانهٔ راتور در جعبه‌ای فلزی ۴۳۹ نامه نگه می‌داشت", "Старый дом и ещё одна жёлтая тетрадь"
NEAR = {"a": "аα", "e": "е", "o": "оο", "T": "ТΤ", "p": "р", "c": "с", "ی": "يى", "ک": "ك", "۴": "٤", "۳": "٣", "۹": "٩", " ": "   　", "е": "e", "о": "o", "а": "a", "ё": "ё"}


def disguise(text, rnd):
    out = []
    for c in text:
        kind = rnd.random()
        if c in NEAR and kind < 0.5:
            c = rnd.choice(NEAR[c]) if len(NEAR[c]) > 1 and "̈" not in NEAR[c] else NEAR[c]
        elif c.isascii() and c.isalnum() and kind < 0.6:
            c = chr(ord(c) + 0xFEE0)
        out.append(c)
        if kind > 0.95:
            out.append(rnd.choice("​⁠­﻿‎"))
    text = "".join(out)
    return unicodedata.normalize("NFD", text) if rnd.random() < 0.3 else text


def normal(text):
    """The plain form: compatibility forms, without invisible characters, look-alikes as one."""
    back = {v: k for k, vs in NEAR.items() if k.isascii() or "؀" <= k <= "ۿ" for v in vs}
    text = unicodedata.normalize("NFKD", text)
    text = "".join(back.get(c, c) for c in text if c not in "​⁠­﻿‎")
    return unicodedata.normalize("NFC", text)


def found(spark, parts, chunks):
    frames = spark.createDataFrame(parts, PARTS), spark.createDataFrame(chunks, CHUNKS)
    return sorted(map(tuple, lookalike.alike_found(*frames).collect()))


def test_against_brute_force(spark):
    rnd = random.Random(4)
    bases = [f"{b} {k}" for b in (LATIN, FA, RU) for k in ("alpha", "beta", "gamma")]
    texts = [rnd.choice([t, disguise(t, rnd)]) for t in bases * 6]
    values = [(("texts", i, n), t) for i, t in enumerate(texts) for n in (0,)]
    expected = []
    for (ka, a), (kb, b) in itertools.combinations(values, 2):
        if a != b and normal(a) == normal(b):
            expected.append(("texts", ka[1], ka[2], kb[1], kb[2]))
    assert len(expected) > 50
    assert found(spark, [], [(i, [t]) for i, t in enumerate(texts)]) == sorted(expected)


def test_what_shows(spark):
    base = "The house of Norven kept 2314 letters"
    seen = [base.lower(), base.replace("o", "ó"), base.replace(" of", "\nof"), base.replace("kept", "ke‌pt"), base.replace("2", "۲"), base + "."]
    assert found(spark, [], [(i, [t]) for i, t in enumerate([base, *seen])]) == []
    hidden = [base.replace("T", "Ｔ"), base.replace("o", "о"), base + "​", base.replace(" ", " ")]
    pairs = found(spark, [], [(i, [t]) for i, t in enumerate([base, *hidden])])
    assert len(pairs) == 10


def test_forms(spark):
    composed = "à côté de la forêt, la clé rouillée"
    assert len(found(spark, [], [(1, [composed, unicodedata.normalize("NFD", composed)])])) == 1
    assert len(found(spark, [], [(1, ["the ﬁne ﬂoor of the office", "the fine floor of the oﬃce"])])) == 1
    assert len(found(spark, [], [(1, ["آن مسئله ساده‌ترین بود و گذشت", "آن مسئله ساده‌ترین بود و گذشت".replace("ي", "ي")])])) == 1
    assert len(found(spark, [], [(1, ["خانهٔ بزرگ در میان باغ سبز", "ﺧانهٔ بزرگ در ﻣیان باغ ﺳبز"])])) == 1


def test_dirt_and_fields(spark):
    a, b = LATIN, LATIN.replace("o", "о")
    parts = [(1, a), (1, a), (2, b), (3, None), (None, a), (4, "short"), (5, ""), (6, "x" * 300_000)]
    chunks = [(1, [a, None, b]), (1, [a, None, b]), (2, None), (3, [])]
    assert found(spark, parts, chunks) == [("texts", 1, 0, 1, 2), ("translation", 1, 0, 2, 0)]
    assert found(spark, [], []) == []
    frames = spark.createDataFrame(parts, PARTS).selectExpr("*", "1 AS text", "2 AS canonical"), spark.createDataFrame(chunks, CHUNKS).selectExpr("*", "1 AS text")
    assert lookalike.alike_found(*frames).count() == 2


def test_canonical(spark):
    a, b = LATIN, LATIN.replace("o", "о")
    frames = spark.createDataFrame([(1, a), (2, b), (3, a)], PARTS), spark.createDataFrame([], CHUNKS)
    assert [tuple(r) for r in lookalike.consistent(*frames).collect()] == [("translation", 2, 0, a)]


def test_copies_make_no_pairs(spark):
    a, b = LATIN, LATIN.replace("o", "о")
    assert len(found(spark, [(i, a) for i in range(300)] + [(999, b)], [])) == 300


def test_many_copies_of_one_spelling(spark):
    """Copies are never compared with each other: 10,000 of one spelling and a variant give 10,000 pairs, and a class."""
    other = LATIN.replace("o", "о")
    chunks = [(i, [LATIN]) for i in range(10_000)] + [(10_000, [other])]
    frames = spark.createDataFrame([], PARTS), spark.createDataFrame(chunks, CHUNKS)
    pairs = lookalike.alike_found(*frames)
    assert pairs.count() == 10_000 and pairs.where("id_b = 10000 AND id_a < id_b").count() == 10_000
    classes = lookalike.alike_classes(*frames)
    assert {(r["links"], r["count"]) for r in classes.groupBy("links").count().collect()} == {(1, 10_000), (10_000, 1)}
    assert classes.select("class_id", "class_no").distinct().count() == 1 and classes.count() == 10_001


def test_letterlike_forms(spark):
    """Mathematical letters, letterlike signs and Roman numerals stand for the letters they are made of."""
    plain = "The house of Norven kept 2314 letters, XII at 20 °C"
    bold = "".join(chr(0x1D400 + ord(c) - 65) if "A" <= c <= "Z" else chr(0x1D41A + ord(c) - 97) if "a" <= c <= "z" else c for c in "Norven")
    seen = [plain.replace("Norven", bold), plain.replace("XII", "Ⅻ"), plain.replace("°C", "℃"), plain.replace("house", "hοuѕe"), plain.replace("kept", "keρt")]
    assert found(spark, [], [(0, [plain]), (1, seen)]) and len(found(spark, [], [(0, [plain]), (1, seen)])) == len(seen) * (len(seen) + 1) // 2
