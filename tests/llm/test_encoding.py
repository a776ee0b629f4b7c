"""Wrongly decoded text: planted damage of known kinds is found and undone, and sound text is left alone."""

from __future__ import annotations

import pytest

from leafstream.llm.encoding import damaged_found, repair, repair_elements

SOUND = {
    "letters": "Ä, Ö, Ü: ÄÖÜ",
    "fr": "Après le long hiver, la factrice égara la clé rouillée près du port. « Où étiez-vous ? » dit l’aîné.",
    "de": "Während des Sturms verrückte der Müller die große Brücke. „Öffne nicht!“, sagte sie.",
    "es": "—¿Dónde pusiste las llaves? —dijo él. Al día siguiente, la niña encontró el jardín.",
    "ru": "Ещё раз смотритель маяка заметил серый плащ. «Надо уйти до дождя.» — сказал он.",
    "ar": "في المساء نفسه وصف صاحب النزل الفانوس الأخضر في القاعة الخالية.",
    "fa": "فانوس‌بان بار دیگر پالتوی خاکستری را زیر طاق‌ها دید. دیگر بزرگ‌ترین گرگ آنجا نبود.",
    "zh": "暴风雨中，客栈老板在港口附近移动了薄笔记本。“大海自有它的账本。”他说。",
    "odd": "(SÃO VELDÊNCIO, ½ ©) — ÇÀ ET LÀ; GRÖßE Â, 45 £, MÜSSIGGÄNGER Ä/Ö, ¿AÑO ÑANDÚ? № 5 «Ъ»",
    "emoji": "It went well 👩‍🚀👍🏽🇮🇷 नि — 20 m² at 5° ½",
    "caps": "ВСЁ ЭТО НАПИСАНО ЗАГЛАВНЫМИ БУКВАМИ",
}


@pytest.mark.parametrize("name", SOUND)
def test_sound(name):
    assert repair(SOUND[name]) is None


@pytest.mark.parametrize(
    ("name", "shown"),
    [(n, "cp1252") for n in ("fr", "de", "es", "ru", "ar", "fa", "zh")] + [("fr", "mac_roman"), ("de", "cp437"), ("es", "cp850"), ("ru", "cp1251"), ("ar", "cp1256"), ("fr", "latin-1"), ("zh", "latin-1")],
)
def test_utf8_read_as(name, shown):
    raw = SOUND[name].encode()
    try:
        damaged = raw.decode(shown)
    except UnicodeDecodeError:
        damaged = "".join(bytes([b]).decode(shown) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)
    found = repair(damaged)
    assert found.text == SOUND[name] and not found.lost


@pytest.mark.parametrize(
    ("name", "true", "shown"),
    [("ru", "cp1251", "cp1252"), ("ru", "cp866", "cp1251"), ("ru", "koi8_r", "cp1251"), ("ar", "cp1256", "cp1252"), ("zh", "gbk", "latin-1"), ("fr", "cp1252", "mac_roman"), ("es", "cp1252", "cp850"), ("de", "cp1252", "mac_roman")],
)
def test_single_byte(name, true, shown):
    text = SOUND[name] if true in ("cp1252", "gbk", "cp1256") else SOUND[name].replace("«", "").replace("»", "").replace("—", "-")
    damaged = "".join(bytes([b]).decode(shown, "replace") for b in text.encode(true))
    found = repair(damaged)
    assert found is not None
    same = sum(a == b for a, b in zip(found.text, text))
    assert same >= 0.95 * len(text)


def test_in_part_and_twice():
    half = "La factrice égara " + "la clé rouillée près du port".encode().decode("cp1252")
    assert repair(half).text == "La factrice égara la clé rouillée près du port"
    twice = "clé rouillée".encode().decode("cp1252").encode().decode("cp1252")
    assert repair(twice).text == "clé rouillée"


def test_lost_characters():
    found = repair("la cl� rouill�e")
    assert found.lost and found.pages == ()
    lossy = "сосед".encode().decode("cp1252", "replace")
    assert repair(lossy).lost
    assert repair("".encode().decode()) is None and repair("plain ASCII") is None


def test_table(spark):
    bad = SOUND["fr"].encode().decode("cp1252")
    rows = [(1, [bad, None, "", SOUND["fr"]]), (1, [bad, None, "", SOUND["fr"]]), (2, None), (None, [bad]), (3, ["é à la " * 50_000]), (4, ["x�y"])]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, texts array<string>").selectExpr("*", "1 AS text", "'x' AS status")
    assert sorted(map(tuple, damaged_found(chunks).collect())) == [(1, 0), (4, 0)]
    rows = {r["chunk_id"]: r for r in repair_elements(chunks).collect()}
    assert rows[1]["repaired"] == SOUND["fr"] and rows[1]["status"] == "recovered" and rows[4]["status"] == "lost"
    assert damaged_found(chunks.limit(0)).count() == 0
