"""Finding personal data in free text: e-mail addresses, phone and identity numbers, street addresses, names.

One pass of a keyword automaton, and short patterns for phone and identity numbers and for initials, mark the places
of a text where something of each kind may stand; only the lines around them are read with the full patterns.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstream.sources.shared import settle

KINDS = ("email", "phone", "id_number", "address", "name")
#: What may be a name, as other documents tell.
MAYBE = "maybe"

# ---- fixed values ------------------------------------------------------------------------------------------

# Given names, by gender.
FEMALE = (
    "Agnes Alice Amina Anna Anouk Astrid Camille Carla Carmen Chiara Chloé Clara Elena Elif Emma Eva Fatima Greta Hana "
    "Helene Ilse Ines Inés Ingrid Irina Isabel Julia Karin Lara Laura Leila Lena Lucía Maria Marta Maya Mei Mira Nadia "
    "Nina Noor Olga Parisa Petra Rosa Sara Sofia Sophie Tamar Tatiana Ursula Vera Wanda Yasmin Yuki Zoe"
).split()
MALE = (
    "Ahmed Aleksandr Ali Andrei Anton Arash Bruno Carlos Daniel Dario David Diego Dmitri Emil Erik Étienne Farid "
    "Felix Finn Georg Giovanni Hans Henrik Hugo Igor Ivan Jakob Jan Jonas José Juan Julien Kamil Karl Lars Louis Luca "
    "Lukas Marco Marek Martin Matteo Mehmet Miguel Nikolai Olivier Omar Óscar Oscar Otto Pablo Pavel Paul Peter Pierre "
    "Rafael Ravi Reza Robert Samuel Sergei Silas Sören Stefan Thomas Tobias Tomás Viktor Yusuf"
).split()
FEMALE_FA = "نگار لیلا پریسا مینا مریم زهرا فاطمه شیرین نسرین سارا نرگس الهام مهسا ژاله آزاده".split()
MALE_FA = "کاوه سهراب فرید آرش رضا علی محمد حسین امیر بهرام داریوش کیان مهدی سعید پرویز".split()
# Usual endings of surnames.
ENDINGS = (
    "feld quist escu ström strom oğlu oglu bane more sen son ova ov etti elli ier wick hart dahl mann berg stein ski "
    "ska wicz enko yan ian ez sson gaard hoff bach burg stad land"
).split()
# What stands before a name.
TITLES = "Dr. Prof. Frau Herr Herrn Mr. Mrs. Ms. Mme Mlle M. Sr. Sra. Dra. Ing. Dr Prof".split()
TITLES_FA = "دکتر خانم آقای استاد".split()
BEFORE_NAME = (
    "__author__ =|respondent|TODO(|FIXME(|annotator|author|written by|Reviewed by|reviewed by|Thanks to|thanks to|"
    "According to|Interview with|interview with|mail from|We met|met with|Merci à|préparé par|Préparé par|"
    "Gracias a|Preparado por|preparado por|Erstellt von|erstellt von|Bearbeitet von|Maintainer:"
).split("|")
# What stands before or after an identity number.
BEFORE_ID = (
    "ssn|SSN|passport|Passport|national_id|national ID|national id|National ID|ID number|identity number|identity card|"
    "Identity card|identity no|DNI|NIE|Ausweis|ausweis|identité|identidad|ملی|گذرنامه|شناسنامه|personal identity"
).split("|")
# Kinds of streets.
STREET_EN = (
    "St|Street|Road|Rd|Lane|Ln|Avenue|Ave|Close|Court|Ct|Drive|Dr|Square|Sq|Way|Terrace|Place|Pl|Crescent|Row|Walk|"
    "Boulevard|Blvd|Gardens|Hill|Mews"
)
STREET_DE = "straße|strasse|str\\.|gasse|weg|allee|platz|ring|damm|ufer|graben|steig"
STREET_FR = "rue|avenue|impasse|boulevard|allée|quai|chemin|cours|square|ruelle|passage"
STREET_ES = "Avda\\.|Avenida|C/|Calle|Plaza|Paseo|Camino|Ronda|Travesía|Cuesta"

# ---- patterns ----------------------------------------------------------------------------------------------

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪİĮĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ"
_AT = r"(?:@|\s?\(at\)\s?|\s?\[at\]\s?|\s@\s|\s(?:AT|at)\s)"
_DOT = r"(?:\.|\s?\[\.\]\s?|\s?\(\.\)\s?|\s?\[dot\]\s?|\s?\(dot\)\s?|\s(?:dot|DOT)\s)"
_EMAIL = re.compile(
    rf"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]*)*{_DOT}[A-Za-z]{{2,}}"
    r"(?![\w-])"
)
#: What follows " at " in an address, and hardly elsewhere.
_HOST = re.compile(rf"[A-Za-z0-9][A-Za-z0-9-]*{_DOT}[A-Za-z0-9]")
#: Numbers as they are written in several countries. The groups of digits are kept apart from plain figures.
_PHONE = re.compile(
    r"(?<![\w+./=#-])(?<!\d[ ,])"
    r"(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){6,11}"
    r"|00(?:[1-9]\d{0,2}-\d{1,4}-?\d{4,10}|(?:[1-9]\d)(?:[ -]?\d){8,11})"
    r"|\(\d{3}\) ?\d{3}[-.]\d{4}|[2-9]\d\d[-.][2-9]\d\d[-.]\d{4}|1-[2-9]\d\d-[2-9]\d\d-\d{4}"
    r"|0\d(?:[. ]\d\d){4}|0\d{1,4}/\d{3,6}-\d{2,5}|0\d{2,4} \d{3,4} \d{3,4}|0\d{2,3}-\d{7,8}"
    r"|[+۰][۰-۹]{2,3}[ -]?[۰-۹](?:[ -]?[۰-۹]){7,10})"
    r"(?![\w/]|[.-]\d)"
)
#: Groups of digits that are a phone number only where they are called one.
_CALLED = re.compile(r"(?i:\b(?:call|phone|tel|telephone|mobile|cell|ring)\b\.?:?|☎) (?:me |us )?(?:at |on )?(\d{3} \d{3} \d{4})(?![\w/]|[.-]\d)")
_PHONE_AT = re.compile(r"\+\d{1,3}[ .(-]?[\d(]|\(\d{3}\) ?\d{3}[-.]\d|\b00[1-9][\d-]|\b0\d{1,4}[ /.-]\d\d|\b[2-9]\d\d[-.]\d{3}[-.]\d{4}\b|\b\d{3} \d{3} \d{4}\b|[۰-۹]{2}")
_ID = re.compile(
    r"(?<![\w.+/@-])(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d{3}[- ]\d{2}[- ]\d{4}|[0-9]{10}|[۰-۹]{10}"
    r"|(?:\d{3}-\d{6}-\d|[۰-۹]{3}-[۰-۹]{6}-[۰-۹])|[A-Z]{1,2}\d{7,8}|[XYZ]?\d{7,8}-?[A-Z])(?![\w@-]|\.\d)"
)
#: The forms of it that count without being called an identity number.
_ID_AT = re.compile(r"(?<![\w.+/@-])(?:[A-Z]{1,2} ?\d\d ?\d\d ?\d\d|\d{7,8}-?[A-Z])")
_DIGITS_ALONE = re.compile(r"[\d۰-۹ -]+$")
_ID_BEFORE = re.compile(f"(?:{'|'.join(BEFORE_ID)})[^.;]*(?:\\b(?:no|nr|No|Nr)\\.[^.;]*)?$")
_ID_AFTER = re.compile(r" (?:as|is|for)\b.{0,16}(?:identity|\bID\b)")
_CITY = rf"[{_UP}][\w’-]+(?: [{_UP}][\w’-]+)?"
#: Between the parts of an address; a line may end there, and a quotation's or comment's sign begin the next.
_SEP = r"(?:, ?\n?|\n)(?:[>#] ?)?"
_UK_CODE = r"[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}"
_ADDRESS_EN = re.compile(
    rf"(?<![\w-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \d+[a-z]?, )?\d+[a-z]? (?:[{_UP}][\w’'-]+ ){{1,3}}(?:{STREET_EN})\b\.?"
    rf"(?:, (?:Apt\.?|Flat|Unit|Suite|Apartment) \d+[a-z]?)?"
    rf"(?:{_SEP}[{_UP}][\w’-]+(?: [{_UP}][a-zß-ÿ][\w’-]*)?(?: (?:\d{{5}}(?!\d)|{_UK_CODE}))?)?"
)
_CODE_CITY = rf"(?:{_SEP}\d{{5}} {_CITY})?"
_ADDRESS_DE = re.compile(
    rf"(?<![\w-])(?:[{_UP}][\wäöüß-]+ )?[{_UP}][\wäöüß-]*(?:{STREET_DE}) \d+ ?[a-z]?\b{_CODE_CITY}"
)
_ADDRESS_FR = re.compile(
    rf"(?<![\w-])\d+(?: bis| ter)?,? (?:{STREET_FR}) (?:de la |de l[’']|du |des |de |d[’'])?[{_UP}][\w’'-]+{_CODE_CITY}"
)
_ADDRESS_ES = re.compile(
    rf"(?<![\w-])(?:{STREET_ES}) ?(?:de las |de los |del |de la |de )?[{_UP}][\w’'-]+(?: [{_UP}][\w’'-]+)? \d+"
    rf"(?:, (?:\d+\.?º ?[A-Z]?|bajo|bajos|ático))?{_CODE_CITY}"
)
_ADDRESS_FA = re.compile(
    r"(?:خیابان|بلوار|میدان) [ء-ۓ‌]+(?: [ء-ۓ‌]+)?(?:، ?\n?|\n)(?:(?:کوچهٔ|کوچه|کوی|بن‌بست) [ء-ۓ‌۰-۹\d]+(?:، ?\n?|\n))?"
    r"(?:پلاک|شمارهٔ|شماره) [۰-۹\d]+(?:، ?واحد [۰-۹\d]+)?"
)
_ADDRESSES = (_ADDRESS_EN, _ADDRESS_FR, _ADDRESS_ES, _ADDRESS_DE, _ADDRESS_FA)

_WORD = rf"[{_UP}](?:[\w’]|'(?=[{_UP}]))*(?:-[{_UP}][\w’]*)?"
_GIVEN_NAME = re.compile(rf"(?<![\w@./\\-])({_WORD})((?: [{_UP}]\.)?) ({_WORD})(?![\w@/\\]|\.\w)")
_COMMA_NAME = re.compile(rf"(?<![\w@./\\-])({_WORD}), ([{_UP}]\.|{_WORD})(?![\w@/\\]|\.\w)")
_INITIAL_NAME = re.compile(rf"(?<![\w@./\\-])[{_UP}]\.(?: ?[{_UP}]\.)? ({_WORD})(?![\w@/\\]|\.\w)")
_INITIAL_AT = re.compile(rf"[{_UP}]\. [{_UP}][\w’-]{{4}}")
#: After a title's blank only, so that not every letter of a long run is tried.
_LONE_NAME = re.compile(rf"(?<= )({_WORD})(?![\w@/\\]|\.\w)")
_FA_NAME = re.compile(
    rf"(?<![\w‌])((?:{'|'.join(FEMALE_FA + MALE_FA)})(?:‌[ء-ۓ]+)?) ([ء-ۓ]+(?:‌[ء-ۓ]+)*)(?![\w‌])"
)
_BEFORE_NAME = re.compile(
    rf"(?:{'|'.join(re.escape(t) for t in TITLES)}|{'|'.join(re.escape(t) for t in BEFORE_NAME)})[\s:='\"(]*$"
)
_TITLE = re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(t) for t in TITLES)}) $")

_FEMALE, _MALE = frozenset(FEMALE), frozenset(MALE)
_GIVEN = _FEMALE | _MALE
_GIVEN_UPPER = frozenset(n.upper() for n in _GIVEN)
_ENDS = tuple(ENDINGS)


def _is_given(word: str) -> bool:
    return all(p in _GIVEN or p in _GIVEN_UPPER for p in word.split("-"))


def _is_surname(word: str) -> bool:
    return len(word) > 4 and word.casefold().replace("i̇", "i").endswith(_ENDS)


# Words that often begin with a capital letter and are no part of a name.
_ORDINARY = frozenset(
    "The This That These Those An In On At For From With And Or But If When While After Before Since As By To Of It We You He She "
    "They I My Our Your His Her Their Its All Some Any Each Every No Not New Old North South East West Central Saint San Santa Los "
    "Las United Data Figure Table Section Chapter Part Step Note Notes Notebook Python University Institute Department Monday "
    "Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October "
    "November December Der Die Das Ein Eine Und Im Le La Les Un Une Et Du Des El Los Una En Y".split()
)


def _shaped(word: str) -> bool:
    """Whether a word has the shape of a name's part: a capital letter and small ones, or parts of that kind."""
    parts = re.split("[-'’]", word)
    return word not in _ORDINARY and len(word) > 1 and all(p[:1].isupper() and (p[1:].islower() or len(p) == 1 or re.fullmatch("Ma?c[A-Z][a-z]+", p)) for p in parts)


def _unheard(text: str, *words: str) -> bool:
    """Whether none of the words stands in small letters in the text, as words of the language do."""
    return not any(re.search(rf"(?<!\w){re.escape(w.lower())}(?!\w)", text) for w in words)


#: Blanks within a line.
_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c != "\n"]
#: Beside the kinds: a sign of an e-mail address if a host follows.
_IF_HOST = 1 << len(KINDS)


def _keywords() -> ahocorasick.Automaton:
    """Each keyword with the kinds of which it is a sign: whatever the patterns accept holds one, or is told by its shape."""
    out: dict[str, int] = {}

    def add(words: list[str], kind: int) -> None:
        for w in words:
            out[w] = out.get(w, 0) | 1 << kind

    add(["@", "(at)", "[at]"], 0)
    out |= {f"{a}{w}{b}": _IF_HOST for w in ("at", "AT") for a in _BLANKS for b in _BLANKS}
    add(BEFORE_ID + ["identity", "ID"], 2)
    add([f" {w}" for w in STREET_EN.split("|")] + [f" {w} " for w in STREET_FR.split("|")], 3)
    add([w.replace("\\", "") for w in STREET_ES.split("|")] + ["خیابان", "بلوار", "میدان"], 3)
    add([w.replace("\\", "") + " " for w in STREET_DE.split("|")], 3)
    given = FEMALE + MALE
    given += [n.upper() for n in given]
    add([f"{w} " for w in given] + [f"{w}-" for w in given] + [f", {w}" for w in given], 4)
    add([f", {c}." for c in map(chr, range(0x180)) if re.match(f"[{_UP}]", c)], 4)
    add([f"{w}{c}" for w in FEMALE_FA + MALE_FA for c in " \u200c"] + BEFORE_NAME, 4)
    add([f"{w}{c}" for w in TITLES for c in [*_BLANKS, *":='\"("]], 4)
    automaton = ahocorasick.Automaton()
    for word, kinds in out.items():
        automaton.add_word(word, kinds)
    automaton.make_automaton()
    return automaton


_KEYWORDS = _keywords()
#: Runs of encoded data, inside which nothing is personal; what else stands on their lines is searched.
_DATA = re.compile(r"data:[\w/+.-]+;base64,[A-Za-z0-9+/=]{200,}|(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{400,}")
_DATA_ONLY = re.compile(r"[A-Za-z0-9+/=]+")


@dataclass(frozen=True)
class Item:
    start: int
    end: int
    kind: str
    text: str


def _block(text: str, at: int) -> tuple[int, int]:
    """The line at a place and the one after it, in which an address may go on."""
    start = text.rfind("\n", 0, at) + 1
    end = text.find("\n", at)
    if end < 0:
        return start, len(text)
    following = text.find("\n", end + 1)
    return start, len(text) if following < 0 else following


def _places(text: str) -> dict[int, set[tuple[int, int]]]:
    """For each kind, the lines in which something of it may stand."""
    places: dict[int, set[tuple[int, int]]] = {k: set() for k in range(5)}
    last = [(-1, -1)] * 5

    def mark(k: int, at: int) -> None:
        if not last[k][0] <= at < last[k][1]:
            start = text.rfind("\n", 0, at) + 1
            end = text.find("\n", at)
            last[k] = (start, len(text) if end < 0 else end)
            places[k].add(last[k])

    for at, kinds in _KEYWORDS.iter(text):
        if kinds == _IF_HOST:
            if _HOST.match(text, at + 1):
                mark(0, at)
            continue
        for k in range(5):
            if kinds >> k & 1:
                mark(k, at)
    for m in _PHONE_AT.finditer(text):
        mark(1, m.start())
    for m in _ID_AT.finditer(text):
        mark(2, m.start())
    for m in _INITIAL_AT.finditer(text):
        places[4].add(_block(text, m.start()))
    return places


def find(text: str) -> list[Item]:
    """The personal data of a text, in order and without overlaps.

    Where kinds overlap, the earlier of e-mail, address, phone, identity number and name holds. Nothing is found
    inside long runs of encoded data, but all that stands before or after one on its line.
    """
    places = _places(text)
    if not any(places.values()):
        return []
    found: list[Item] = []
    taken: list[tuple[int, int]] = []  # in order, none over another
    data: list[tuple[int, int]] | None = None

    def encoded(start: int, end: int) -> bool:
        nonlocal data
        if not _DATA_ONLY.fullmatch(text, start, end):
            return False
        if data is None:
            data = [m.span() for m in _DATA.finditer(text)]
        at = bisect.bisect_right(data, (start, len(text))) - 1
        return at >= 0 and end <= data[at][1]

    def keep(start: int, end: int, kind: str) -> None:
        if encoded(start, end):
            return
        at = bisect.bisect_left(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (start, end))
            found.append(Item(start, end, kind, text[start:end]))

    for start, end in sorted(places[0]):
        for m in _EMAIL.finditer(text, start, end):
            keep(m.start(), m.end(), "email")
    for start, end in sorted(places[3]):
        # an address goes on over two more lines at most
        _, stop = _block(text, _block(text, start)[1])
        for pattern in _ADDRESSES:
            for m in pattern.finditer(text, start, stop):
                if m.start() <= end:
                    keep(m.start(), _address_end(text, m), "address")
    for start, end in sorted(places[1]):
        for m in _PHONE.finditer(text, start, end):
            keep(m.start(), m.end(), "phone")
        for m in _CALLED.finditer(text, start, end):
            keep(*m.span(1), "phone")
    for start, end in sorted(places[2]):
        for m in _ID.finditer(text, start, end):
            # digits alone are a number of anything, unless they are called one close by
            if not _DIGITS_ALONE.match(m.group()) or (
                _ID_BEFORE.search(text, max(start, m.start() - 44), m.start()) or _ID_AFTER.match(text, m.end(), end)
            ):
                keep(m.start(), m.end(), "id_number")
    for start, end in sorted(places[4]):
        for a, b in _names(text, start, end):
            keep(a, b, "name")
    # names told by others of the document: the same in another place, and those that a mail address spells out
    told = {i.text for i in found if i.kind == "name" and " " in i.text and "," not in i.text}
    told.update(_spelt_out([i.text for i in found if i.kind == "email"], text))
    for name in told:
        for at in _standing(name, text):
            keep(at, at + len(name), "name")
    return sorted(found, key=lambda i: i.start)


def _standing(name: str, text: str) -> Iterator[int]:
    """Where a name stands by itself, and not as part of a word, a path or an address."""
    at = text.find(name)
    while at >= 0:
        before, after = text[at - 1 : at], text[at + len(name) : at + len(name) + 2]
        inside = before and (before.isalnum() or before in "_@./\\-")
        if not inside and not (after and (after[0].isalnum() or after[0] in "_@/\\-" or after[0] == "." and after[1:].isalnum())):
            yield at
        at = text.find(name, at + 1)


_LOCAL = re.compile(r"([A-Za-z]{2,})[._-]([A-Za-z]{2,})\d*(?:@|\W)")


def _spelt_out(mails: list[str], text: str) -> Iterator[str]:
    """The names of a text, as it writes them, that a mail address such as jo.smith@... is made of."""
    small = ""
    for m in filter(None, map(_LOCAL.match, mails)):
        small = small or text.lower()
        if len(small) != len(text):  # some capital letter has two small ones
            small = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for a, b in (m.groups(), m.groups()[::-1]):
            for at in _standing(f"{a} {b}".lower(), small):
                pair = text[at : at + len(a) + len(b) + 1]
                if all(map(_shaped, pair.split(" "))):
                    yield pair


#: Two capitalized words: a name where the corpus has it as one elsewhere.
_MAYBE = re.compile(rf"(?<![\w@./\\'-])([{_UP}]\w+(?:-[{_UP}]\w+)?) ([{_UP}][\w'’]+(?:-[{_UP}]\w+)?)(?![\w@/\\]|\.\w)")


def candidates(text: str, found: list[Item]) -> list[Item]:
    """Pairs of capitalized words outside of what is found, in the shape of a name."""
    starts, ends = [i.start for i in found], [i.end for i in found]
    out, at = [], 0
    while m := _MAYBE.search(text, at):
        at = m.start(2)
        k = bisect.bisect_right(starts, m.start()) - 1
        free = (k < 0 or ends[k] <= m.start()) and (k + 1 == len(starts) or m.end() <= starts[k + 1])
        if free and _shaped(m.group(1)) and _shaped(m.group(2)):
            out.append(Item(m.start(), m.end(), MAYBE, m.group()))
    return out


def _address_end(text: str, m: re.Match[str]) -> int:
    """Where an address ends: a full stop after its last word ends a sentence, unless it shortens a street's name."""
    end = m.end()
    if text[end - 1] == "." and not re.search(r"(?:\b(?:St|Rd|Ave|Ln|Ct|Sq|Dr|Pl|Blvd)|str)\.$", text[m.start() : end]):
        end -= 1
    return end


def _names(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    line_end = end
    for m in _COMMA_NAME.finditer(text, start, line_end):
        surname, given = m.group(1), m.group(2)
        # any word may stand before a comma and a name; a surname, or what follows a cue, is part of it
        cue = _BEFORE_NAME.search(text, max(start, m.start() - 40), m.start())
        # an initial before a surname belongs to that
        initial = given[-1] == "." and not _follows(text, m.end(), line_end)
        if not _is_given(surname) and (_is_surname(surname) and (_is_given(given) or initial) or cue and _is_given(given)):
            yield m.start(), m.end()
    at = start
    while m := _GIVEN_NAME.search(text, at, line_end):
        given, surname = m.group(1), m.group(3)
        at = m.end()
        cue = _BEFORE_NAME.search(text, max(start, m.start() - 40), m.start())
        if _is_given(given) and not (_is_given(surname) and _follows(text, m.end(), line_end)):
            yield m.start(), m.end()
        elif cue and (_is_surname(surname) or _is_given(given) or _shaped(given) and _shaped(surname) and _unheard(text, given, surname)):
            yield m.start(), m.end()
        else:
            at = m.start(3)
    for m in _INITIAL_NAME.finditer(text, start, line_end):
        cue = _BEFORE_NAME.search(text, max(start, m.start() - 40), m.start())
        if _is_surname(m.group(1)) or cue:
            yield m.start(), m.end()
    for m in _FA_NAME.finditer(text, start, line_end):
        yield m.start(), m.end()
    for m in _LONE_NAME.finditer(text, start, line_end):
        if _TITLE.search(text, max(start, m.start() - 8), m.start()) and (_is_surname(m.group(1)) or _shaped(m.group(1)) and _unheard(text, m.group(1))):
            yield m.start(), m.end()


def _follows(text: str, at: int, end: int) -> bool:
    """Whether another capitalized word follows, so that two given names are not the whole name."""
    m = re.compile(rf" {_WORD}").match(text, at, end)
    return bool(m and _is_surname(m.group()[1:]))


ITEMS = "doc_id bigint, text_hash bigint, pii_start int, pii_end int, pii_type string, pii_text string"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, code, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
            found = find(text)
            rows += [(doc_id, code, i.start, i.end, i.kind, i.text) for i in (*found, *candidates(text, found))]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        columns = list(zip(*rows)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in ITEMS.split(", ")])


def personal_items(documents: DataFrame) -> DataFrame:
    """Each place of personal data once (see :data:`ITEMS`), positions in code points and the end exclusive.

    Each document is searched by itself first. What is surely a name in one, by its given name, its ending or what
    stands before it, is then a name wherever the corpus has the same two words. Null and empty texts, and rows without
    doc_id, have none; rows of one doc_id with different texts are told apart by `text_hash`.
    """
    rows = documents.where("doc_id IS NOT NULL AND length(text) > 0").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    every = settle(rows.mapInArrow(_items, ITEMS).distinct(), "items")
    sure = every.where(F.col("pii_type") != MAYBE)
    known = sure.where("pii_type = 'name'").select("pii_text").distinct()
    told = every.where(F.col("pii_type") == MAYBE).join(known, "pii_text", "left_semi").withColumn("pii_type", F.lit("name"))
    return sure.unionByName(told)


def personal_found(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, pii_text): every distinct item of a document."""
    return personal_items(documents).select("doc_id", "pii_type", "pii_text").distinct()
