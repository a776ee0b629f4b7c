"""Values that look alike on screen but are stored as different characters.

A look-alike map in SQL turns each value into a skeleton: full-width forms become plain, Arabic letter forms
Persian, Cyrillic and Greek letters that look Latin become Latin, blanks one kind of blank, and invisible
characters go. Skeletons are grouped under an accent-sensitive Unicode collation, which also takes composed and
decomposed accents as equal; each class gets a canonical member, which is joined back.

Only values whose reduced skeleton occurs in two spellings can have a partner. They are found first, from
hashes alone, so that of all texts none but those few move.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstream.llm.values import once, text_elements
from leafstream.sources.shared import settle

#: Fewest letters or digits of a value that counts.
LEAST = 20

# Letters of other scripts and the Latin letters they look like.
_CYRILLIC = ("АВЕЅІЈКМНОРСТУХаеорсухіјѕԁԛԝһҮѴѵ", "ABESIJKMHOPCTYXaeopcyxijsdqwhYVv")
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρυ", "ABEZHIKMNOPTYXoavpu")
_LATIN = ("ɡɑ", "ga")
# Arabic forms of a letter or digit and the Persian ones.
_ARABIC = ("يىكە٠١٢٣٤٥٦٧٨٩", "ییکه۰۱۲۳۴۵۶۷۸۹")
_INVISIBLE = "\xad\u034f\u061c\u180e\u200b\u200d\u200e\u200f" + "".join(
    chr(c) for c in (*range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFE0F, 0xFEFF)
)
_BLANKS = "\t\xa0\u1680\u202f\u205f\u3000" + "".join(chr(c) for c in range(0x2000, 0x200B))
_HYPHENS = ("‐‑", "--")
#: Characters that are visible but that the collation would pass over or take as equal: a zero-width non-joiner,
#: and digits of other scripts. In skeletons they stand as private characters, which it orders apart.
_NON_JOINER, _ITS_PLACE = "\u200c", "\ue000"
_PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
_DIGIT_PLACES = "".join(chr(0xE100 + i) for i in range(10))


def _single_forms() -> dict[str, str]:
    """Each character with one look-alike character, by rule and by the lists above."""
    near = {a: b for pair in (_CYRILLIC, _GREEK, _LATIN, _ARABIC, _HYPHENS) for a, b in zip(*pair)}
    out: dict[str, str] = {}
    # compatibility forms: letterlike forms, Roman numerals, full and half width, Arabic presentation forms, mathematical letters
    for low, high in ((0x2100, 0x214F), (0x2160, 0x2188), (0xFB00, 0xFB06), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0xFF01, 0xFFEF), (0x1D400, 0x1D7FF)):
        for code in range(low, high + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain != chr(code):
                out[chr(code)] = near.get(plain, plain)
    # composed letters of the other scripts on a base that looks Latin, or Persian
    for low, high in ((0x0370, 0x052F), (0x0622, 0x06D3), (0x1F00, 0x1FFF)):
        for code in range(low, high + 1):
            parts = unicodedata.normalize("NFD", chr(code))
            if len(parts) > 1 and parts[0] in near:
                plain = unicodedata.normalize("NFC", near[parts[0]] + parts[1:])
                if len(plain) == 1:
                    out[chr(code)] = plain
    out.update(near)
    out.update(dict.fromkeys(_BLANKS, " "))
    out[_NON_JOINER] = _ITS_PLACE
    places = dict(zip(_PERSIAN_DIGITS, _DIGIT_PLACES))
    return {c: places.get(p, p) for c, p in out.items()} | places


def _long_forms() -> list[tuple[str, str]]:
    """Characters that stand for several: ligatures, and composed letters whose Persian form is not composed."""
    near = dict(zip(*_ARABIC))
    out = []
    for low, high in ((0xFB00, 0xFB06), (0xFEF5, 0xFEFC)):
        out += [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(low, high + 1)]
    for code in range(0x0622, 0x06D4):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in near and len(unicodedata.normalize("NFC", near[parts[0]] + parts[1:])) > 1:
            out.append((chr(code), near[parts[0]] + parts[1:]))
    return [(a, b) for a, b in out if len(b) > 1]


def _wide_forms() -> list[tuple[str, str]]:
    """Signs of several letters: letterlike forms and Roman numerals, such as ℃ and Ⅷ."""
    codes = [*range(0x2100, 0x2150), *range(0x2160, 0x2189)]
    return [(chr(c), plain) for c in codes if len(plain := unicodedata.normalize("NFKC", chr(c))) > 1]


_SINGLE = _single_forms()
_LONG = _long_forms()
_WIDE = _wide_forms()


def _spelt(text: Column) -> Column:
    """A text with signs of several letters spelt out; most have none, and are not looked through for each of them."""
    forms = F.array(*[F.struct(F.lit(form).alias("form"), F.lit(plain).alias("plain")) for form, plain in _WIDE])
    out = F.aggregate(forms, text, lambda t, f: F.replace(t, f["form"], f["plain"]))
    return F.when(F.rlike(text, F.lit("[\u2100-\u214f\u2160-\u2188]")), out).otherwise(text)


def skeleton(text: Column) -> Column:
    """The look-alike skeleton of a text."""
    text = _spelt(text)
    for form, plain in _LONG:
        text = F.replace(text, F.lit(form), F.lit(plain))
    # translate drops the characters beyond the length of its third argument
    matching = "".join(_SINGLE) + _INVISIBLE
    return F.translate(text, matching, "".join(_SINGLE.values()))


def _bare(base: str) -> str:
    """The first part of a composed character, as the skeleton shows it."""
    first = unicodedata.normalize("NFD", base)[0]
    return _SINGLE.get(first, first)


def reduced(text: Column) -> Column:
    """A rougher form, equal for all texts whose skeletons the collation can take as equal: without accents,
    composed or not."""
    single = dict(_SINGLE)
    for low, high in ((0x00C0, 0x024F), (0x0370, 0x0527), (0x0622, 0x06D3), (0x1E00, 0x1FFF)):
        for code in range(low, high + 1):
            bare = _bare(_SINGLE.get(chr(code), chr(code)))
            if bare != chr(code):
                single[chr(code)] = bare
    drop = _INVISIBLE + "".join(
        chr(c) for c in [*range(0x300, 0x370), *range(0x64B, 0x660), 0x670, *range(0x6D6, 0x6DD)] if chr(c) not in single
    )
    text = _spelt(text)
    for form, plain in _LONG:
        plain = "".join(_bare(c) for c in plain if not unicodedata.combining(c))
        if len(plain) > 1:
            text = F.replace(text, F.lit(form), F.lit(plain))
        else:
            single[form] = plain
    return F.translate(text, "".join(single) + drop, "".join(single.values()))


def counts(text: Column) -> Column:
    """Whether a value has enough letters or digits."""
    return (F.length(text) >= LEAST) & F.rlike(text, F.lit(r"(?s)(?:[\p{L}\p{N}][^\p{L}\p{N}]*+){%d}" % LEAST))


def values(parts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(field_name, id, no, text) of the answers and of the elements of texts that count.

    Nulls and values with too few letters or digits are left out; repeated rows may still be there.
    """
    answers = parts.where(F.col("part_id").isNotNull() & counts(F.col("translation"))).select(
        F.lit("translation").alias("field_name"),
        F.col("part_id").alias("id"),
        F.lit(0).alias("no"),
        F.col("translation").alias("text"),
    )
    elements = text_elements(chunks, keep=counts(F.col("text"))).select(
        F.lit("texts").alias("field_name"),
        F.col("chunk_id").alias("id"),
        F.col("text_no").alias("no"),
        "text",
    )
    return answers.unionByName(elements)


def variants(all_values: DataFrame) -> DataFrame:
    """(field_name, id, no, text, canonical) of the values whose class has more than one spelling.

    `canonical` is the class's most frequent spelling, the smallest of those in a tie.
    """
    keyed = all_values.withColumn("rough", F.xxhash64("field_name", reduced(F.col("text"))))
    # two spellings of one rough form, told by hashes; a few of all values, and the only ones that move
    several = (
        keyed.select("rough", F.xxhash64("text").alias("spelling"))
        .groupBy("rough")
        .agg(F.min("spelling").alias("low"), F.max("spelling").alias("high"))
        .where("low <> high")
        .select("rough")
    )
    few = once(keyed.join(several, "rough", "left_semi").drop("rough"), "field_name", "id", "no")
    shaped = few.withColumn("shape", F.collate(skeleton(F.col("text")), "UNICODE"))
    spellings = shaped.groupBy("field_name", "shape", "text").agg(F.count(F.lit(1)).alias("n"))
    best = spellings.groupBy("field_name", "shape").agg(
        F.count(F.lit(1)).alias("spellings"),
        F.min_by("text", F.struct(-F.col("n"), F.col("text"))).alias("canonical"),
    )
    return shaped.join(best.where("spellings > 1"), ["field_name", "shape"]).select(
        "field_name", "id", "no", "text", "canonical"
    )


def consistent(parts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(field_name, id, no, canonical) of each value that is to be replaced, the rest being canonical already."""
    return variants(values(parts, chunks)).where(F.col("text") != F.col("canonical")).select(
        "field_name", "id", "no", "canonical"
    )


#: Parts that the members of one spelling are spread over, so that no task holds all of a frequent one.
PARTS = 16


def _spellings(found: DataFrame) -> DataFrame:
    """(field_name, canonical, text, spelling, n): the spellings of each class, named by their first members."""
    member = F.struct("id", "no")
    return found.groupBy("field_name", "canonical", "text").agg(F.min(member).alias("spelling"), F.count(F.lit(1)).alias("n"))


def alike_classes(parts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(field_name, id, no, class_id, class_no, links): one row for each value that has a look-alike, with the first
    member of its class and the number of values that look the same in another spelling. Linear in the values."""
    found = settle(variants(values(parts, chunks)), "variants")
    spellings = settle(_spellings(found), "spellings")
    classes = spellings.groupBy("field_name", "canonical").agg(F.min("spelling").alias("c"), F.sum("n").alias("members"))
    known = spellings.join(classes, ["field_name", "canonical"]).select("field_name", "text", "c", (F.col("members") - F.col("n")).alias("links"))
    rows = found.join(known, ["field_name", "text"])
    return rows.select("field_name", "id", "no", F.col("c.id").alias("class_id"), F.col("c.no").alias("class_no"), "links")


def alike_found(parts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(field_name, id_a, no_a, id_b, no_b): the pairs of values of one class in different spellings.

    Spellings are paired first, and each pair's members then, so that the work grows with the pairs that come out:
    exact copies, however many, are never compared with each other.
    """
    found = settle(variants(values(parts, chunks)), "variants")
    spellings = settle(_spellings(found), "spellings")
    named = spellings.select("field_name", "text", "spelling")
    members = found.join(named, ["field_name", "text"]).select("field_name", "spelling", F.struct("id", "no").alias("m"))
    members = settle(members.withColumn("part", F.pmod(F.xxhash64("m"), F.lit(PARTS)).cast("int")), "members")
    a = spellings.select("field_name", "canonical", F.col("spelling").alias("a"))
    b = spellings.select("field_name", "canonical", F.col("spelling").alias("b"))
    pairs = a.join(b, ["field_name", "canonical"]).where("a < b").select("field_name", "a", "b")
    spread = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    left = spread.join(members.withColumnRenamed("spelling", "a").withColumnRenamed("m", "ma"), ["field_name", "a", "part"]).drop("a", "part")
    both = left.join(members.drop("part").withColumnRenamed("spelling", "b").withColumnRenamed("m", "mb"), ["field_name", "b"])
    first, last = F.least("ma", "mb"), F.greatest("ma", "mb")
    return both.select(
        "field_name", first["id"].alias("id_a"), first["no"].alias("no_a"), last["id"].alias("id_b"), last["no"].alias("no_b")
    )
