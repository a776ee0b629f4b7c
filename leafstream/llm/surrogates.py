"""Keyed surrogates for personal data.

The same item has the same surrogate wherever it stands, however it is written there, and different items have
different ones. A surrogate keeps the type, script and format of what it replaces, and a given name its gender.
Numbers go through keyed permutations of their digits, which cannot collide. Names, places and mail addresses
are made from keyed hashes; a check over the distinct items of the corpus finds those that collide, and makes
them anew.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafstream.llm import personal
from leafstream.sources.shared import settle

ROUNDS = 6

_ASCII = str.maketrans("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
_PERSIAN = str.maketrans("0123456789", "۰۱۲۳۴۵۶۷۸۹")
# Syllables that surrogate names are made of.
_ONSETS = "b br c cal d dor f fen g gal h hal k kel l lor m mar n nor p pel r ros s sel t tor v vel w wen".split()
_NUCLEI = "a e i o u an en in on ar er or el il al is".split()
_ONSETS_FA = "با بر دا در فر فا گل گر هم کا کی لا ما مه نا نو پا پر را رو سا سر تا تو وا زر شا شی جا چم خا یا".split()
_NUCLEI_FA = "ن ر م د ش ز ل ک نا را می لی نی ری دا مان".split()


def _digest(key: str, *parts: object) -> int:
    raw = "\x1f".join(map(str, parts)).encode()
    return int.from_bytes(hmac.new(key.encode(), raw, hashlib.blake2b).digest()[:16], "big")


def permute_digits(digits: str, key: str, use: str = "") -> str:
    """A keyed permutation of the digit strings of one length: a Feistel network over its two halves."""
    if not digits:
        return digits
    if len(digits) == 1:
        return str((int(digits) * 7 + _digest(key, use, "one")) % 10)
    half = len(digits) // 2
    left, right = digits[:half], digits[half:]
    for turn in range(ROUNDS):
        if turn % 2:
            shift = _digest(key, use, len(digits), turn, left) % 10 ** len(right)
            right = str((int(right) + shift) % 10 ** len(right)).zfill(len(right))
        else:
            shift = _digest(key, use, len(digits), turn, right) % 10 ** len(left)
            left = str((int(left) + shift) % 10 ** len(left)).zfill(len(left))
    return left + right


@lru_cache(maxsize=64)
def _shuffled(key: str, use: str, items: tuple[str, ...]) -> dict[str, str]:
    """A keyed permutation of a list, which moves each item."""
    order = sorted(items, key=lambda x: _digest(key, use, x))
    return dict(zip(order, order[1:] + order[:1]))


def _word(number: int, syllables: int, persian: bool = False) -> str:
    onsets, nuclei = (_ONSETS_FA, _NUCLEI_FA) if persian else (_ONSETS, _NUCLEI)
    out = []
    for _ in range(syllables):
        number, a = divmod(number, len(onsets))
        number, b = divmod(number, len(nuclei))
        out.append(onsets[a] + nuclei[b])
    return "".join(out)


def _like(word: str, model: str) -> str:
    """A word in the case of another."""
    if model.isupper() and len(model) > 1:
        return word.upper()
    return word.capitalize() if model[:1].isupper() else word


def _persian(text: str) -> bool:
    return any("؀" <= c <= "ۿ" for c in text)


# ---- forms: what makes two ways of writing the same item ---------------------------------------------------

_DOTS = re.compile(r"\s?[\[(](?:\.|dot)[\])]\s?|\s(?:dot|DOT)\s")
_ATS = re.compile(r"\s?[\[(]at[\])]\s?|\s(?:AT|at|@)\s")
_CODES = ("98", "44", "49", "33", "34", "39", "1")


def _national(digits: str, plus: bool) -> tuple[str, str]:
    """The prefix of a phone number, and its digits within the country."""
    if plus or digits.startswith("00"):
        start = 0 if plus else 2
        for code in _CODES:
            if digits[start:].startswith(code):
                end = start + len(code)
                if digits[end : end + 1] == "0" and len(digits) - end > 9:
                    end += 1  # a trunk zero, as in +44 (0)20
                return digits[:end], digits[end:]
        return digits[: start + 2], digits[start + 2 :]
    if digits.startswith("0"):
        return "0", digits[1:]
    return "", digits


def _name_parts(text: str) -> tuple[str, str]:
    """(given, surname) of a name in any of its forms; either may be empty."""
    if "," in text:
        surname, given = (x.strip() for x in text.split(",", 1))
        return given, surname
    words = text.split()
    if len(words) == 1:
        return "", words[0]
    return words[0], words[-1]


def form(kind: str, text: str) -> str:
    """The form that all ways of writing an item share."""
    plain = text.translate(_ASCII)
    if kind == "email":
        return _ATS.sub("@", _DOTS.sub(".", plain)).casefold()
    if kind == "phone":
        digits = re.sub(r"\D", "", plain)
        return _national(digits, plain.lstrip().startswith("+"))[1]
    if kind == "id_number":
        return re.sub(r"[\W_]", "", plain).upper()
    if kind == "name":
        # given names are permuted, so that only surnames can come to share one; all forms of a person have theirs
        return _name_parts(plain)[1].casefold()
    return re.sub(r"[\W_]+", " ", plain).strip().casefold()


# ---- surrogates --------------------------------------------------------------------------------------------


# Letters that stand in for each other in given names that no list holds.
_CLASSES = tuple(map(tuple, ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöüåøæ", "çñčćšžğşłďťňř", "بپتثجچحخدذرزژسشصضطظعغفقکگلمنهی", "اآوئ")))


def _swapped(word: str, key: str) -> str:
    """A word with other letters of their own kind between its first and its last, which stay: for initials to agree
    and for its ending to tell what it told. By place and length a permutation, so that no two words share one."""
    bare = word.lower()
    if len(bare) < 3:
        return word
    inner = range(1, len(bare) - (1 if len(bare) > 3 else 0))
    out = list(bare)
    for at in inner:
        for letters in _CLASSES:
            if bare[at] in letters:
                out[at] = _shuffled(key, f"letters {at} {len(bare)}", letters)[bare[at]]
    return _like("".join(out), word)


def _given(word: str, key: str) -> str:
    if word.endswith("."):
        return word
    out = []
    for part in word.split("-"):
        for use, names in (
            ("f", personal.FEMALE),
            ("m", personal.MALE),
            ("ffa", personal.FEMALE_FA),
            ("mfa", personal.MALE_FA),
        ):
            known = {n.casefold(): n for n in names}
            if part.casefold() in known:
                name = known[part.casefold()]
                # of the same initial, so that "A. Berg" still goes with "Anna Berg"; Persian names are not shortened so
                same = tuple(names) if _persian(part) else tuple(n for n in names if n[0] == name[0])
                out.append(_like(_shuffled(key, use + same[0], same)[name], part) if len(same) > 1 else _swapped(part, key))
                break
        else:
            out.append(_swapped(part, key))
    return "-".join(out)


def _surname(word: str, key: str, attempt: int, syllables: int) -> str:
    bare = word.casefold()
    return _like(_word(_digest(key, "surname", bare, attempt), syllables, _persian(word)), word)


def _refill(text: str, digits: str) -> str:
    """A text with other digits in the places and the script of its own."""
    rest = iter(digits)
    return "".join(
        (next(rest).translate(_PERSIAN) if _persian(c) else next(rest)) if c.isdigit() else c for c in text
    )


def surrogate(kind: str, text: str, key: str, attempt: int = 0, syllables: int = 3) -> str:
    """The surrogate of an item, written as the item is; `attempt` is above 0 where an earlier one collided, and
    `syllables` is the length of surnames."""
    if kind == "phone":
        digits = re.sub(r"\D", "", text.translate(_ASCII))
        prefix, own = _national(digits, text.lstrip().startswith("+"))
        return _refill(text, prefix + permute_digits(own, key, "phone"))
    if kind == "id_number":
        digits = re.sub(r"\D", "", text.translate(_ASCII))
        letters = _shuffled(key, "letters", tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        changed = "".join(letters.get(c, c) for c in text)
        return _refill(changed, permute_digits(digits, key, "id"))
    if kind == "email":
        return _email(text, key, attempt)
    if kind == "name":
        return _name(text, key, attempt, syllables)
    return _address(text, key, attempt)


def _email(text: str, key: str, attempt: int) -> str:
    m = re.match(r"(.*?)(\s?[\[(]at[\])]\s?|\s(?:AT|at|@)\s|@)(.*)", text, re.S)
    if not m:
        return text
    local, at, domain = m.groups()
    whole = form("email", text)
    number = _digest(key, "email", whole, attempt)
    made = re.sub(r"[^\W\d_]+", lambda w: "\0", local)
    parts = made.count("\0")
    words = [_word(number >> (18 * i), 2) for i in range(max(1, parts))]
    found = iter(words)
    name = made if parts else words[0]
    name = re.sub("\0", lambda _: next(found), name)
    if sum(map(len, words)) < 9:
        name += str(number >> 90)[:4]
    last = re.split(r"([\[(]\.[\])]|\s?[\[(]dot[\])]\s?|\s(?:dot|DOT)\s|\.)", domain)
    host = _word(_digest(key, "domain", form("email", "a@" + domain)), 3)
    dot = last[-2] if len(last) > 1 else "."
    out = f"{name}{at}{host}{dot}example"
    return out.upper() if text.isupper() else out


def _name(text: str, key: str, attempt: int, syllables: int) -> str:
    if "," in text:
        surname, given = (x.strip() for x in text.split(",", 1))
        return f"{_surname(surname, key, attempt, syllables)}, {_given(given, key)}"
    words = text.split(" ")
    if len(words) == 1:
        return _surname(words[0], key, attempt, syllables)
    return " ".join([_given(words[0], key), *words[1:-1], _surname(words[-1], key, attempt, syllables)])


_KEPT = re.compile(
    rf"^(?:{personal.STREET_EN}|{personal.STREET_FR}|bis|ter|de|la|las|los|del|du|des|bajo|bajos|ático|Flat|Apt|Unit|Suite"
    r"|Avda|Avenida|C|Calle|Plaza|Paseo|Camino|Ronda|Travesía|Cuesta|خیابان|بلوار|میدان|کوچهٔ|کوچه|کوی|پلاک|شمارهٔ|واحد"
    r"|[A-Z]{1,2}|[a-zA-Z]|º)$"
)
_TAIL = re.compile(rf"(?:{personal.STREET_DE.replace(chr(92) + '.', '')})$")


def _address(text: str, key: str, attempt: int) -> str:
    whole = form("address", text)

    def word(m: re.Match[str]) -> str:
        w = m.group()
        if _KEPT.match(w):
            return w
        tail = _TAIL.search(w)
        made = _word(_digest(key, "place", w.casefold(), attempt), 3, _persian(w))
        return _like(made + (tail.group() if tail and tail.start() else ""), w)

    worded = re.sub(r"[^\W\d_]+(?:‌[^\W\d_]+)*", word, text)
    digits = re.sub(r"\D", "", text.translate(_ASCII))
    number = str(_digest(key, "numbers", whole, attempt) % 10 ** max(1, len(digits))).zfill(len(digits))
    return _refill(worded, number)


# ---- over a corpus -----------------------------------------------------------------------------------------


def _maker(key: str, syllables: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, texts, attempts = (batch.column(c).to_pylist() for c in ("pii_type", "pii_text", "attempt"))
            made = [surrogate(k, t, key, a, syllables) for k, t, a in zip(kinds, texts, attempts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("pii_type"),
                    pa.array([form(k, t) for k, t in zip(kinds, texts)], pa.string()),
                    pa.array([form(k, m) for k, m in zip(kinds, made)], pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array(attempts, pa.int32()),
                ],
                names=["pii_type", "form", "made", "pii_text", "attempt"],
            )

    return make


_MADE = "pii_type string, form string, made string, pii_text string, attempt int"


def attempts(items: DataFrame, key: str, most: int = 8, syllables: int = 3) -> DataFrame:
    """(pii_type, form, attempt) of the items whose first surrogate belongs to another item.

    All distinct items are compared by their surrogates; among those that share one, the smallest keeps it and
    the others try again, until none is shared. If some still are after `most` rounds, an error is raised.
    """
    distinct = items.select("pii_type", "pii_text", F.lit(0).alias("attempt")).distinct()
    seen = settle(distinct.mapInArrow(_maker(key, syllables), _MADE), "forms")
    # one way of writing stands for each form
    forms = seen.groupBy("pii_type", "form").agg(F.min(F.struct("pii_text", "made", "attempt")).alias("s"))
    current = forms.select("pii_type", "form", "s.pii_text", "s.made", "s.attempt")
    for tried in range(most + 1):
        current = settle(current, "attempts")
        order = Window.partitionBy("pii_type", "made").orderBy("attempt", "form")
        shared = current.groupBy("pii_type", "made").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        ranked = current.join(shared, ["pii_type", "made"]).withColumn("r", F.row_number().over(order))
        again = ranked.where("r > 1").select("pii_type", "pii_text", (F.col("attempt") + 1).alias("attempt"))
        anew = settle(again.mapInArrow(_maker(key, syllables), _MADE), "again")
        if anew.isEmpty():
            break
        if tried == most:
            raise RuntimeError(f"{anew.count()} items still share their surrogates after {most} rounds")
        kept = current.join(anew.select("pii_type", "form"), ["pii_type", "form"], "left_anti")
        current = kept.unionByName(anew.select("pii_type", "form", "pii_text", "made", "attempt"))
    return current.where("attempt > 0").select("pii_type", "form", "attempt")


def _replacer(key: str, surrogates: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, items in zip(batch.column("text").to_pylist(), batch.column("items").to_pylist()):
                parts, at = [], 0
                for i in sorted(items or (), key=lambda x: x["pii_start"]):
                    kind, own = i["pii_type"], text[i["pii_start"] : i["pii_end"]]
                    made = f": {surrogate(kind, own, key, i['attempt'])}" if surrogates else ""
                    parts += [text[at : i["pii_start"]], f"[{kind.upper()}{made}]"]
                    at = i["pii_end"]
                out.append(None if text is None else "".join([*parts, text[at:]]))
            counts = [len(x or ()) for x in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int32()), pa.array(out, pa.string())],
                names=["doc_id", "n_items", "text"],
            )

    return replace


def pseudonymize(documents: DataFrame, key: str, surrogates: bool = True) -> DataFrame:
    """(doc_id, n_items, text): each document with its personal data behind typed placeholders.

    A placeholder is the type and the surrogate in brackets, as in ``[NAME: Marel Toran]``, or the type alone
    without `surrogates`; the items are those of :func:`personal.personal_items`. `key` is the run's secret. Null texts
    stay null, repeated rows stay as many, and rows without doc_id are left out.
    """
    items = settle(personal.personal_items(documents), "items")
    place = ["doc_id", "text_hash"]
    if surrogates:
        anew = attempts(items, key)
        formed = items.mapInArrow(_former, "doc_id bigint, text_hash bigint, pii_start int, pii_end int, pii_type string, form string")
        tried = formed.join(anew, ["pii_type", "form"], "left").withColumn(
            "attempt", F.coalesce("attempt", F.lit(0))
        )
    else:
        tried = items.withColumn("attempt", F.lit(0))
    # the items of one document: bounded by its length
    by_document = tried.groupBy(*place).agg(
        F.collect_list(F.struct("pii_start", "pii_end", "pii_type", "attempt")).alias("items")
    )
    rows = documents.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(by_document, place, "left")
    return rows.mapInArrow(_replacer(key, surrogates), "doc_id bigint, n_items int, text string")


def _former(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, texts = batch.column("pii_type").to_pylist(), batch.column("pii_text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("doc_id", "text_hash", "pii_start", "pii_end", "pii_type")],
                pa.array([form(k, t) for k, t in zip(kinds, texts)], pa.string()),
            ],
            names=["doc_id", "text_hash", "pii_start", "pii_end", "pii_type", "form"],
        )
