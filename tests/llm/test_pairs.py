"""Defective pairs: the label model on planted defects, and the validation of its cutoffs."""

from __future__ import annotations

import random

import pytest

from leafstream.llm import pairs

NAMES = [("Anna", "آنا"), ("Peter", "پیتر"), ("Mira", "میرا"), ("Omar", "عمر")]
VERBS = [("found the old boat", "قایق کهنه را پیدا کرد"), ("closed the white door", "در سفید را بست"), ("painted a long wall", "دیوار بلندی را رنگ زد"), ("sold the round table", "میز گرد را فروخت")]
FRENCH = "Le vieux maître de la maison était dans le jardin avec sa sœur et les enfants, et il dit que le soir ne vient pas."


def pair(rnd, n):
    chosen = [(rnd.choice(NAMES), rnd.choice(VERBS), rnd.randint(10, 400)) for _ in range(n)]
    source = " ".join(f"After {k} hours, {a[0]} {v[0]}." for a, v, k in chosen)
    answer = " ".join(f"پس از {k} ساعت، {a[1]} {v[1]}." for a, v, k in chosen)
    return source, answer


def planted(seed=1, n=600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source, answer = pair(rnd, rnd.randint(3, 9))
        defect = rnd.choice([None] * 14 + list(pairs.DEFECTS))
        if defect == "empty":
            answer = rnd.choice([None, "", " \n", "<<<1>>>\n<<<2>>>", "```\n```", "​…"])
        elif defect == "refusal":
            answer = rnd.choice(["I'm sorry, but I can't help with translating this passage.", "متأسفم، اما نمی‌توانم این متن را ترجمه کنم.", "Je suis désolé, je ne peux pas traduire ce passage."])
        elif defect == "copied":
            answer = rnd.choice([source, source.upper(), "Here is the translation:\n\n" + source, source.replace(".", " ."), f"<<<1>>>\n{source}"])
        elif defect == "wrong_language":
            answer = " ".join([FRENCH] * rnd.randint(1, 3))
        elif defect == "truncated":
            answer = answer[: rnd.randint(len(answer) // 8, len(answer) // 2)]
        rows.append((i, source, answer, defect))
    return rows


PARTS = "part_id bigint, source string, translation string"


def labels(spark, rows):
    frame = spark.createDataFrame([r[:3] for r in rows], PARTS)
    return {r["part_id"]: r for r in pairs.label_pairs(frame).collect()}


def test_planted(spark):
    rows = planted()
    found = labels(spark, rows)
    wrong = [(r, found[r[0]]["defect"]) for r in rows if found[r[0]]["defect"] != r[3]]
    assert len(found) == len(rows) and len(wrong) <= 0.02 * len(rows), wrong[:5]


@pytest.mark.parametrize("defect", pairs.DEFECTS)
def test_cutoffs(spark, defect):
    """On held-out pairs, no other cutoff would do clearly better than the one set."""
    rows = planted(seed=9)
    found = labels(spark, rows)
    scored = [(found[r[0]][f"p_{defect}"], r[3] == defect) for r in rows]

    def f1(cut):
        hit = sum(t for p, t in scored if p > cut)
        return 2 * hit / max(1, sum(p > cut for p, _ in scored) + sum(t for _, t in scored))

    best = max(f1(c / 20) for c in range(1, 20))
    assert f1(pairs.CUTOFFS[defect]) >= best - 0.02 and best > 0.9


def test_sound_edges(spark):
    fa = "فانوس‌بان بار دیگر پالتوی خاکستری را زیر طاق‌ها دید. خیاط پس از ۲۸۹ ساعت نامه را پیدا کرد."
    dialogue = "“I am sorry, I cannot help you.” said Anna. After 20 hours, Anna found the old boat."
    rows = planted(n=300) + [
        (1001, fa, fa, None),  # a Persian source unchanged
        (1002, dialogue, "آنا گفت: «متأسفم، نمی‌توانم کمکتان کنم.» پس از ۲۰ ساعت، آنا قایق کهنه را پیدا کرد.", None),
        (1003, "Chapter 7", "فصل ۷", None),
        (1004, "After 20 hours, Anna found the old boat in the harbour —", "پس از ۲۰ ساعت، آنا قایق کهنه را پیدا کرد", None),
        (1005, None, "پس از ۲۰ ساعت، آنا قایق کهنه را پیدا کرد.", None),
        (1006, None, None, "empty"),
        (1007, "x " * 3000, ("پس از ۲۰ ساعت، آنا قایق کهنه را پیدا کرد. " * 200)[:6000], None),
    ]
    found = labels(spark, rows)
    assert {i: found[i]["defect"] for i in range(1001, 1008)} == {r[0]: r[3] for r in rows if r[0] > 1000}


def test_refusals_anywhere(spark):
    """Answers that decline late, after an echo, in a long frame or at length; and sound ones that speak of declining."""
    rnd = random.Random(4)
    long = "Thank you for sending me this part of your book, which I have read with great interest from its beginning to its end. "
    declines = [
        "I'm sorry, but I can't help with translating this passage.", "Unfortunately I cannot fulfil this request.",
        "متأسفم، اما نمی‌توانم این متن را ترجمه کنم.", "Je suis désolé, je ne peux pas traduire ce passage.",
        "Leider kann ich diesen Text nicht übersetzen.", "Lo siento, no puedo traducir este fragmento.",
    ]
    rows, n = planted(n=400), 5000
    for decline in declines:
        source, answer = pair(rnd, 8)
        for whole in (
            long * 4 + decline, long * 20 + decline + " " + long, decline + " " + long * 5, f"“{source}”\n\n{decline}",
            source[: len(source) // 3] + "\n\n" + decline, source + "\n\n" + decline, answer[: len(answer) // 2] + "\n" + decline, FRENCH * 6 + " " + decline,
        ):
            rows.append((n, source, whole, "refusal"))
            n += 1
    fa = "پس از ۲۰ ساعت، آنا قایق کهنه را پیدا کرد. "
    sound = [
        ("After 20 hours, Anna found the old boat. " * 9 + "He asked for leave. They gave none.", fa * 9 + "درخواست کرد که اجازه دهند. ندادند."),
        ("After 20 hours, Anna found the old boat. " * 9 + "I cannot translate this letter, Anna wrote.", fa * 9 + "آنا نوشت نمی‌توانم این نامه را ترجمه کنم."),
        ("After 20 hours, Anna found the old boat. " * 9 + "“I cannot translate it.”", fa * 9 + "«نمی‌توانم ترجمه‌اش کنم.»"),
    ]
    for source, answer in sound:
        rows.append((n, source, answer, None))
        n += 1
    found = labels(spark, rows)
    wrong = [(r, found[r[0]]["defect"]) for r in rows if r[0] >= 5000 and found[r[0]]["defect"] != r[3]]
    assert not wrong, (len(wrong), wrong[:3])
    sure = [r for r in rows if r[0] < 5000]
    assert sum(found[r[0]]["defect"] != r[3] for r in sure) <= 0.02 * len(sure)


def test_short_sources_copied(spark):
    """A short source returned in a frame is a copy; one that is a small part of a longer answer is not."""
    rows = planted(n=300) + [
        (6001, "Kapitel 24", "Translation: Kapitel 24", "copied"),
        (6002, "Kapitel 24", "KAPITEL 24.", "copied"),
        (6003, "The End", "Here is the translation:\n\nThe End", "copied"),
        (6004, "Le jardin", "Le jardin (ترجمه)", "copied"),
        (6005, "Chapter 7", "Translation: فصل ۷", None),
        (6007, "Anna found the old boat.", "آنا قایق کهنه را پیدا کرد.", None),
    ]
    found = labels(spark, rows)
    assert {r[0]: found[r[0]]["defect"] for r in rows if r[0] > 6000} == {r[0]: r[3] for r in rows if r[0] > 6000}


def test_tables(spark):
    frame = spark.createDataFrame([], PARTS)
    assert pairs.defects_found(frame).count() == 0
    rows = [(1, "A b c.", None), (1, "A b c.", None), (None, "A", None)]
    frame = spark.createDataFrame(rows, PARTS).selectExpr("*", "1 AS origin", "2 AS ratio", "'x' AS empty", "3 AS usual")
    assert [tuple(r) for r in pairs.defects_found(frame).collect()] == [(1, "empty")]


def test_learning_ignores_noise():
    patterns = {"---": 9000, "+++": 300, "-+-": 200, "+--": 150, "++0": 60, "0--": 500}
    learned = pairs.learn(patterns)
    assert learned["+++"] > 0.95 and learned["---"] < 0.01 and learned["-+-"] < 0.5 and learned["++0"] > 0.5
    assert pairs.learn({}) == {}


# ---- held-out pairs, of other wording than those above -----------------------------------------------------------

SUBJECTS = [("Die Nachbarin", "همسایه"), ("Der alte Kapitän", "ناخدای پیر"), ("Ein junger Schreiner", "نجاری جوان"), ("Meine Tante", "خاله‌ام"), ("Der Postbote", "نامه‌رسان"), ("Die Lehrerin", "آموزگار")]
PREDICATES = [
    ("trug die Kisten langsam zum Hafen hinunter", "جعبه‌ها را آهسته تا بندر پایین برد"),
    ("erzählte den Kindern von dem langen Winter", "برای بچه‌ها از زمستان بلند تعریف کرد"),
    ("vergaß den Regenschirm wieder im Zug", "باز چترش را در قطار جا گذاشت"),
    ("wartete bis zum Abend auf eine Antwort", "تا غروب چشم به راه پاسخ ماند"),
    ("reparierte das Dach vor dem ersten Schnee", "پیش از نخستین برف بام را تعمیر کرد"),
]
OTHER_LANGUAGE = "La barca verde quedó en la orilla y los pescadores no la vieron, porque la niebla era muy densa y la noche ya estaba cerca."
REFUSALS = [
    "I am not able to translate this material, as it goes against my guidelines.", "Diesen Text kann ich leider nicht übersetzen.",
    "من قادر نیستم این بخش را به فارسی ترجمه کنم.", "It is not possible for me to provide a translation of this content.",
    "به عنوان یک مدل زبان، از ترجمهٔ این متن معذورم.",
]


def statements(rnd, n):
    """(source, answer) as lists of sentences; few hold numbers, and answers are freely worded in length."""
    rows = []
    for _ in range(n):
        a, v = rnd.choice(SUBJECTS), rnd.choice(PREDICATES)
        k = rnd.randint(3, 90)
        number = rnd.random() < 0.25
        extra = rnd.choice(["", "، آرام و بی‌صدا", "، چنان که همه می‌گفتند"])
        rows.append((f"{a[0]} {v[0]}" + (f" und zählte {k} Möwen." if number else "."), f"{a[1]} {v[1]}{extra}" + (f" و {k} مرغ دریایی شمرد." if number else ".")))
    return [r[0] for r in rows], [r[1] for r in rows]


def held_out(seed, n=1500, rate=0.3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source, answer = statements(rnd, rnd.randint(4, 14))
        text, whole, defects = " ".join(source), " ".join(answer), set()
        kind = rnd.choice([*pairs.DEFECTS, "refusal+copied", "refusal+truncated", "refusal+wrong_language"]) if rnd.random() < rate else ""
        defects |= set(filter(None, kind.split("+")))
        refusal = rnd.choice(REFUSALS)
        if kind == "empty":
            whole = rnd.choice(["", "…", "<<<1>>>", "```\n```", None])
        elif kind == "refusal":
            whole = refusal
        elif kind == "copied":
            whole = rnd.choice([text, "Übersetzung:\n" + text, text.replace("ß", "ss"), " ".join(source[: max(4, len(source) - 1)])])
        elif kind == "wrong_language":
            whole = " ".join([OTHER_LANGUAGE] * rnd.randint(1, 3))
        elif kind == "refusal+wrong_language":
            whole = " ".join([OTHER_LANGUAGE] * 3) + "\n\n" + refusal
        elif kind == "truncated":
            kept = answer[: max(1, int(len(answer) * rnd.uniform(0.15, 0.55)))]
            whole = " ".join(kept)
            whole = whole if rnd.random() < 0.5 else whole[: -rnd.randint(2, 9)]
        elif kind == "refusal+copied":
            whole = text + "\n\n" + refusal
        elif kind == "refusal+truncated":
            whole = " ".join(answer[: max(2, len(answer) // 2 - 1)]) + "\n\n" + refusal
        elif rnd.random() < 0.1:
            whole = whole[:-1]  # sound, without its last full stop
        elif rnd.random() < 0.1:
            whole = "؛ ".join(x.rstrip(".") for x in answer) + "."  # sound, its sentences run together
        rows.append((i, text, whole, defects))
    return rows


def test_label_model_beats_majority(spark):
    """On pairs of other wording the label model makes fewer mistakes than a majority of the same votes."""
    rows = held_out(5)
    frame = spark.createDataFrame([r[:3] for r in rows], PARTS)
    votes = {r["part_id"]: r for r in pairs.vote(frame).collect()}
    found = labels(spark, rows)
    wrong = {"model": 0, "majority": 0}
    for i, _, _, defects in rows:
        for d in pairs.DEFECTS:
            majority = votes[i][d].count("+") > votes[i][d].count("-")
            wrong["majority"] += majority != (d in defects)
            wrong["model"] += (d in found[i]["defects"]) != (d in defects)
    assert wrong["model"] < wrong["majority"] and wrong["model"] <= 0.01 * len(rows) * len(pairs.DEFECTS), wrong


def test_two_defects(spark):
    """Pairs with two planted defects get both."""
    rows = held_out(6)
    found = labels(spark, rows)
    for both in ({"refusal", "copied"}, {"refusal", "truncated"}, {"refusal", "wrong_language"}):
        own = [r for r in rows if r[3] == both]
        got = sum(both <= set(found[r[0]]["defects"]) for r in own)
        assert len(own) > 30 and got >= 0.95 * len(own), (both, got, len(own), [(r, found[r[0]]["defects"]) for r in own if not both <= set(found[r[0]]["defects"])][:2])


@pytest.mark.parametrize("defect", pairs.DEFECTS)
def test_cutoffs_on_other_wording(spark, defect):
    rows = held_out(7)
    found = labels(spark, rows)
    scored = [(found[r[0]][f"p_{defect}"], defect in r[3]) for r in rows]

    def f1(cut):
        hit = sum(t for p, t in scored if p > cut)
        return 2 * hit / max(1, sum(p > cut for p, _ in scored) + sum(t for _, t in scored))

    best = max(f1(c / 20) for c in range(1, 20))
    assert f1(pairs.CUTOFFS[defect]) >= best - 0.02 and best > 0.9, (f1(pairs.CUTOFFS[defect]), best)


def test_source_behind_persian_sentences(spark):
    """An answer that repeats the whole source is a copy, whatever share of Persian stands before it."""
    rnd = random.Random(3)
    source, answer = (" ".join(x) for x in statements(rnd, 6))
    rows = planted(n=300) + [(7001, source, " ".join([answer] * 2) + "\n\n" + source, None)]
    votes = {r["part_id"]: r for r in pairs.vote(spark.createDataFrame([r[:3] for r in rows], PARTS)).collect()}
    assert votes[7001]["copied"][0] == "+" and votes[7001]["copied"][2] == "+"
