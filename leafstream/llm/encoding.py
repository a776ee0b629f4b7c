"""Finding and repairing text that was decoded with the wrong character encoding.

The characters of a text are mapped back to the bytes of a legacy code page; an automaton over the byte
structure of UTF-8 finds the maximal well-formed multibyte spans, and only those spans are decoded. An automaton
over the pairs of GBK does the same for two-byte Chinese. For single-byte pages, which have no byte structure, runs of characters are
compared as they stand and as the other page would show them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstream.llm.values import once, text_elements

LOST = "�"


def _page(name: str) -> dict[str, int]:
    """Character to byte of a legacy page's upper half; bytes it leaves undefined stand as control characters."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if name in ("cp1252", "cp1251", "cp1256"):
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


#: The pages that text is shown in by mistake.
SHOWN = ("cp1252", "mac_roman", "cp850", "cp437", "cp1251", "cp1256")
_BYTES = {name: _page(name) for name in SHOWN}
#: Bytes without a character in cp1252; decoders put LOST in their place.
_UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)


def _members(page: dict[str, int], low: int, high: int, lost: bool = False) -> str:
    chars = [c for c, b in page.items() if low <= b <= high] + ([LOST] if lost else [])
    return "[" + "".join(re.escape(c) for c in chars) + "]"


def _automaton(page: dict[str, int], gaps: bool) -> re.Pattern[str]:
    """The well-formed multibyte sequences of UTF-8, once or more in a row, over a page's characters; with
    `gaps`, LOST may stand for a byte that the page leaves undefined."""
    part = lambda low, high, lost=False: _members(page, low, high, lost and gaps)
    rest = part(0x80, 0xBF, True)
    lead3 = "|".join(
        (
            part(0xE0, 0xE0) + part(0xA0, 0xBF, True),
            part(0xE1, 0xEC) + rest,
            part(0xED, 0xED) + part(0x80, 0x9F, True),
            part(0xEE, 0xEF) + rest,
        )
    )
    lead4 = "|".join(
        (part(0xF0, 0xF0) + part(0x90, 0xBF, True), part(0xF1, 0xF3) + rest, part(0xF4, 0xF4) + part(0x80, 0x8F, True))
    )
    return re.compile(f"(?:{part(0xC2, 0xDF)}{rest}|(?:{lead3}){rest}|(?:{lead4}){rest}{rest})+")


#: The characters of each page that can begin a sequence, and those that can go on with it.
_LEADS = {name: frozenset(c for c, b in page.items() if 0xC2 <= b <= 0xF4) for name, page in _BYTES.items()}
_GO_ON = {name: frozenset(LOST).union(c for c, b in page.items() if 0x80 <= b <= 0xBF) for name, page in _BYTES.items()}
#: A beginning and a going-on of any page: where they don't meet there is no sequence.
_MEET = re.compile(
    "[" + "".join(map(re.escape, sorted(frozenset().union(*_LEADS.values()))))
    + "][" + "".join(map(re.escape, sorted(frozenset().union(*_GO_ON.values())))) + "]"
)
_SPANS = {name: _automaton(page, name == "cp1252") for name, page in _BYTES.items()}

_CYRILLIC = re.compile("[А-яЁё]")
_ARABIC = re.compile("[ء-غف-ْٰٓٔپچژکگۀی۰-۹٠-٩،؛؟ـ‌]")
_HAN = re.compile("[一-鿿　-〃《-】！-／：-？０-９]")
_MARKS = re.compile("[\xa0-\xbf\u200c-\u200f\u2010-\u2027\u2030-\u203a€™№−]")
_LATIN = re.compile("[À-ÿŒœŠšŽžŸƒ]")


@dataclass(frozen=True)
class Repair:
    text: str
    pages: tuple[str, ...]
    lost: bool


def _decode(span: str, page: dict[str, int]) -> list[str]:
    """The characters of a span; a sequence with a lost byte gives its one usual reading, else LOST."""
    out, at = [], 0
    while at < len(span):
        lead = page[span[at]]
        size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        raw = [page.get(c, -1) for c in span[at : at + size]]
        at += size
        if -1 not in raw:
            out.append(bytes(raw).decode("utf-8", "replace"))
            continue
        found = set()
        if raw.count(-1) == 1:
            for b in _UNDEFINED:
                try:
                    c = bytes(b if x == -1 else x for x in raw).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if _kind(c) in ("cyrillic", "arabic", "latin", "han") or c == "”":
                    found.add(c)
        out.append(found.pop() if len(found) == 1 else LOST)
    return out


def _kind(c: str) -> str:
    if c == LOST:
        return "lost"
    if _CYRILLIC.match(c):
        return "cyrillic"
    if _ARABIC.match(c):
        return "arabic"
    if _HAN.match(c):
        return "han"
    if _LATIN.match(c):
        return "latin"
    if _MARKS.match(c):
        return "mark"
    if ord(c) > 0xFFFF and ord(c) < 0x20000 or c in "️﻿ˆ˜":
        return "mark"
    return "control" if "\x80" <= c <= "\x9f" else ""


def _sound(text: str, m: re.Match[str], chars: list[str], shown: str, sure: bool) -> bool:
    """Whether a span is better read as `chars`. One sequence alone may be chance; several in a row, or one
    in a text with sure spans, are not."""
    kinds = [_kind(c) for c in chars]
    if not all(kinds) or all(k in ("lost", "control") for k in kinds) and not sure:
        return False
    span, before, after = m.group(), text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
    if shown in ("cp1251", "cp1256"):
        own = _CYRILLIC if shown == "cp1251" else _ARABIC
        # a span of nothing but the page's own letters, within a word of them, is a word as it stands
        if all(own.match(c) for c in span) and (own.match(before or " ") or own.match(after or " ")):
            return False
        if "han" in kinds and len(chars) < 4:
            return False
        return len(chars) >= 2 or sure or len(span) >= 3
    if len(chars) >= 2 or len(span) >= 3 or sure:
        return True
    if kinds[0] in ("cyrillic", "arabic"):
        return False
    if shown == "cp1252":
        # capital letter and quotation mark or space: chance, unless small letters stand around it
        if before.isupper() or after.isupper() and not before.islower():
            return not (span[1] in "\xa0»”“’ " or span[1].isspace()) and not after.isupper()
    return True


def _multibyte(text: str) -> tuple[str, list[str]]:
    """One round over all pages: the text with its well-formed spans decoded, and the pages at fault."""
    best: tuple[int, str, str] | None = None
    if not _MEET.search(text):
        return text, []
    present = set(text)
    for shown in SHOWN:
        if present.isdisjoint(_LEADS[shown]) or present.isdisjoint(_GO_ON[shown]):
            continue
        page = _BYTES[shown]
        spans = list(_SPANS[shown].finditer(text))
        if not spans:
            continue
        read = [_decode(m.group(), page) for m in spans]
        sure = any(
            _sound(text, m, chars, shown, False) and (len(chars) >= 2 or len(m.group()) >= 3)
            for m, chars in zip(spans, read)
        )
        out, at, gain = [], 0, 0
        for m, chars in zip(spans, read):
            if _sound(text, m, chars, shown, sure):
                out += [text[at : m.start()], *chars]
                at = m.end()
                gain += len(m.group())
        if gain and (best is None or gain > best[0]):
            best = gain, shown, "".join([*out, text[at:]])
    return (best[2], [best[1]]) if best else (text, [])


def _covered(text: str, start: int, end: int) -> float:
    """The greatest part of the high characters of a run, out to the next blanks, that one page's automaton
    takes as multibyte spans."""
    run = text[text.rfind(" ", 0, start) + 1 : end + (text[end:] + " ").index(" ")]
    high = sum(c > "\x7f" for c in run)
    return max(sum(map(len, _SPANS[shown].findall(run))) for shown in SHOWN) / max(1, high)


# ---- pages of one byte a character -------------------------------------------------------------------------

_CP1252 = "".join(c for c in _BYTES["cp1252"])
_HIGH_WORD = re.compile("[" + re.escape(_CP1252) + LOST + "]+")
_THREE_HIGH = re.compile("[" + re.escape(_CP1252) + "]{3}")
_HIGH_RUN = re.compile(
    "[" + re.escape(_CP1252) + LOST + "](?:[" + re.escape(_CP1252) + LOST + "0-9 .,:;!?\"'()\\-]*[" + re.escape(_CP1252) + LOST + "])?"
)
#: The usual letters of Russian by falling frequency.
_RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфё"
_WEIGHT = {c: 1.0 - i / 16 for i, c in enumerate(_RUSSIAN)}


def _russian(text: str) -> float:
    """How usual the letters of a text are in Russian, and whether their case is."""
    score = 0.0
    for word in re.findall("[^\\W\\d_]+", text):
        for at, c in enumerate(word):
            weight = _WEIGHT.get(c.lower(), -2.0)
            score += weight if c.islower() or at == 0 or c in "Ёё" else weight - 1.5
    return score


def _to_bytes(run: str) -> bytes:
    page = _BYTES["cp1252"]
    return bytes(page[c] if c in page else ord(c) for c in run)


def _two_byte(page: dict[str, int]) -> re.Pattern[str]:
    """The well-formed two-byte sequences of GBK, once or more in a row, over a page's characters: a lead of 81 to FE, and
    behind it 40 to FE but 7F."""
    low = "".join(re.escape(chr(b)) for b in range(0x40, 0x7F))
    trail = _members(page, 0x80, 0xFE)
    return re.compile(f"(?:{_members(page, 0x81, 0xFE)}[{low}{trail[1:-1]}])+")


_TWO_BYTE = _two_byte(_BYTES["cp1252"])


def _chinese(run: str) -> str | None:
    """A run with its two-byte spans decoded, if they hold all its high characters, and mostly usual ones."""
    out, at = [], 0
    for m in _TWO_BYTE.finditer(run):
        try:
            read = _to_bytes(m.group()).decode("gbk")
        except UnicodeDecodeError:  # pairs that the page leaves undefined
            return None
        out += [run[at : m.start()], read]
        at = m.end()
    between = "".join([*out[::2], run[at:]])
    if not between.isascii():
        return None
    high = "".join(out[1::2])
    usual = sum(1 for c in high if "一" <= c <= "鿿" and 0xB0 <= c.encode("gbk")[0] <= 0xD7)
    marks = sum(1 for c in high if c in "，。“”‘’！？：；、（）—…《》")
    return "".join([*out, run[at:]]) if usual >= 2 and usual + marks >= 0.85 * len(high) else None


_ARABIC_WORD = re.compile("^[ء-غف-ْپچژگکیڈٹںھہ‌،؛؟٠-٩ـ]+$")


def _single(text: str) -> tuple[str, list[str]]:
    """Runs of Western letters that are Cyrillic, Arabic or Chinese in another page."""
    pages: list[str] = []
    if not _THREE_HIGH.search(text):
        return text, pages

    def better(m: re.Match[str]) -> str:
        run = m.group()
        words = _HIGH_WORD.findall(run)
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if before.isascii() and before.isalpha() or after.isascii() and after.isalpha():
            return run
        letters = [w for w in words if sum(c.isalpha() or c in "¸·˜¿" for c in w) >= 3]
        if not letters or LOST in run or _covered(m.string, m.start(), m.end()) > 0.75:
            return run
        raw = _to_bytes(run)
        chinese = _chinese(run)
        cyrillic = raw.decode("cp1251", "replace")
        arabic = raw.decode("cp1256", "replace")
        high = [w for w in re.findall("[^\\W\\d_]+", arabic)]
        fits = sum(len(w) for w in high if _ARABIC_WORD.match(w)) / max(1, sum(map(len, high)))
        common = sum(c in "اليرنمود" for c in arabic) / max(1, sum(map(len, high)))
        russian = _russian(cyrillic) / max(1, sum(map(len, re.findall("[^\\W\\d_]+", cyrillic))))
        choices = []
        if russian > 0.15:
            choices.append((russian + 0.3, "cp1251", cyrillic))
        if fits > 0.9 and common > 0.2:
            choices.append((fits * (0.3 + common), "cp1256", arabic))
        if chinese and run.count(" ") * 15 <= len(chinese):
            choices.append((1.2 if "，" in chinese or "。" in chinese else 0.7, "gbk", chinese))
        if not choices:
            # some letters may be a list of letters; many are no word of any language
            if sum(map(len, letters)) >= 6:
                pages.append("unknown")
            return run
        _, page, fixed = max(choices)
        pages.append(page)
        return fixed

    return _HIGH_RUN.sub(better, text), list(dict.fromkeys(pages))


_CP1251 = {b: c for c, b in _BYTES["cp1251"].items()}
_ODD = "ЎўЈ¤Ґ¦§Ё©Є«¬®Ї\xad\xa0ЂЃ‚ѓ„…†‡€‰Љ‹ЊЌЋЏђ‘’“”•–—\x98™љ›њќћџ"
_CYR_RUN = re.compile("[А-яЁё" + re.escape(_ODD) + "]+(?:[ .,:;!?0-9\\-]+[А-яЁё" + re.escape(_ODD) + "]+)*")
_BOX = re.compile("[─-▟]")
_CYR = re.compile("[Ѐ-ӿ]")
_CYR_RARE = re.compile("[ЎўЈ¤Ґ¦©Є¬®ЇЂЃѓ†‡‰ЉЊЌЋЏђљњќћџ]")
_WORDS_UP = re.compile("(?<![^\\W\\d_])(?:[а-яё][А-ЯЁЈ]{2,}|[А-ЯЁЈ]{2,})(?![^\\W\\d_])")


_KOI_WORD = "(?<![^\\W\\d_])(?:[а-яё][А-ЯЁЈ]+|[А-ЯЁЈ]+|[а-яё])(?![^\\W\\d_])"
_KOI_RUN = re.compile(f"{_KOI_WORD}(?:[ .,:;!?0-9\\-]+{_KOI_WORD})*")


def _cyrillic(text: str) -> tuple[str, list[str]]:
    """Cyrillic of an older page (KOI8-R, cp866) that was read as cp1251."""
    pages: list[str] = []
    page = _BYTES["cp1251"]

    def as_page(run: str, name: str) -> str:
        return "".join(bytes([page[c]]).decode(name, "replace") if c in page else c for c in run)

    if _CYR_RARE.search(text):

        def better(m: re.Match[str]) -> str:
            run = m.group()
            core = run.strip("\xa0\xad «»„“”‘’…—–")
            if not _CYR_RARE.search(core) or len(core) < 3 or len(_CYR.findall(core)) < 0.3 * len(core):
                return run
            around = m.string[m.start() - 1 : m.start()] + m.string[m.end() : m.end() + 1]
            if any(c.isalpha() for c in around) or _covered(m.string, m.start(), m.end()) > 0.75:
                return run
            if _russian(as_page(run, "koi8_r")) > _russian(as_page(run, "cp866")):
                return run
            words = run.split(" ")
            out, changed = [], False
            for word in words:
                fixed = as_page(word, "cp866")
                letters = re.findall("[А-яЁё]", fixed)
                garbled = _CYR_RARE.search(word) or changed or "\xa0" in word
                if letters and garbled and not _BOX.search(fixed) and _russian(fixed) > _russian(word):
                    out.append(fixed)
                    changed = True
                else:
                    out.append(word)
            if not changed:
                return run
            pages.append("cp866")
            # words without rare characters that stood before the first such word
            whole = as_page(run, "cp866")
            return whole if _russian(whole) > _russian(" ".join(out)) and not _BOX.search(whole) else " ".join(out)

        text = _CYR_RUN.sub(better, text)
    ups = _WORDS_UP.findall(text)
    if ups:
        fixed = as_page(" ".join(ups), "koi8_r")
        now = " ".join(w.lower() for w in ups)
        mixed = any(w[0].islower() for w in ups)
        n = sum(map(len, ups))
        if n >= 4 and (_russian(fixed) - _russian(now)) / n > (0.05 if mixed else 0.12) and _russian(fixed) > 0:
            pages.append("koi8_r")
            text = _KOI_RUN.sub(
                lambda m: as_page(m.group(), "koi8_r") if _WORDS_UP.search(m.group()) else m.group(), text
            )
    return text, pages


_WEST_SMALL = set("àáâäçèéêëìíîïñòóôöùúûüÿæœßãõåø")
_WEST_LARGE = set("ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜŸÆŒÃÕÅØ")


def _fits(prev: str, c: str, following: str) -> float:
    """How well a character suits its neighbours in Western text."""
    letter_before, letter_after = prev.isalpha(), following.isalpha()
    if c in _WEST_SMALL:
        if not letter_before and not letter_after:
            return 0.5 if c == "à" else -1.0
        if following.isupper() or prev in ".?!,…":
            return -2.0
        return 0.2 if c == "õ" else 0.8 if c in "òìùãåøëÿæ" else 1.0
    if c in _WEST_LARGE:
        if prev.islower():
            return -2.0
        return 1.0 if letter_before or letter_after or c in "ÀÉÓÁ" else -0.5
    if c in "’":
        return 1.0 if letter_before or letter_after else 0.0
    if c in "“„«‘¿¡":
        return 1.0 if letter_after and not letter_before or following.isspace() or prev in ".?!" else 0.0
    if c in "”»":
        return 1.0 if not letter_after else -1.0
    if c in "—–":
        return 0.5
    if "─" <= c <= "▟":
        return -2.0 if letter_before or letter_after else -1.5
    if c in "´¨¸ˆ˜" or c in "ªº" and prev.isspace():
        return -1.0 if not (letter_before or letter_after) else -2.0
    if c in "ªº°²³¹":
        return 0.0 if prev.isdigit() or not letter_before and not letter_after else -2.0
    if letter_before or letter_after:
        return -2.0
    return 0.0


_PLAIN = re.compile("[A-Za-z]")
_BOXES = frozenset(map(chr, range(0x2500, 0x25A0)))
_OTHER = re.compile("[Ѐ-ӿ؀-ۿ一-鿿]")
_BLANKS = "\xa0\xad\u202f\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u3000" + LOST + "".join(map(chr, range(0x2000, 0x200B)))
_VISIBLE_HIGH = re.compile("[^\x00-\x7f" + _BLANKS + "]")


def _western(text: str) -> tuple[str, list[str]]:
    """Western text of cp1252 that was read as Mac Roman or a DOS page."""
    if not _PLAIN.search(text) or _OTHER.search(text):
        return text, []
    places = [m.start() for m in _VISIBLE_HIGH.finditer(text)]
    padded = " " + text + " "
    fits = {i: _fits(padded[i], text[i], padded[i + 2]) for i in places}
    if "ã" in text or "ç" in text:  # Portuguese
        fits = {i: 1.0 if text[i] == "õ" else fit for i, fit in fits.items()}
    elif sum(text[i] == "õ" for i in places) > 1:
        fits = {i: -1.0 if text[i] == "õ" else fit for i, fit in fits.items()}
    if sum(text[i] in _BOXES for i in places) > 6:  # a drawing
        fits = {i: 0.5 if text[i] in _BOXES else fit for i, fit in fits.items()}
    if min(fits.values(), default=0) > -1:
        return text, []
    best = (0.0, "", text)
    for shown in ("mac_roman", "cp850", "cp437"):
        page = _BYTES[shown]
        chars = list(padded)
        gain = 0.0
        for i, now in fits.items():
            if now >= 0.5:
                continue
            b = page.get(text[i])
            c = LOST if b is None else bytes([b]).decode("cp1252", "replace")
            if c != LOST and (then := _fits(padded[i], c, padded[i + 2])) >= 0.5:
                chars[i + 1] = c
                gain += then - now
        if shown == "mac_roman":
            for i, c in enumerate(text, 1):
                if c == "\xa0" and padded[i - 1].isupper() and padded[i + 1].isupper():
                    chars[i] = "Ê"
        if gain > best[0]:
            best = gain, shown, "".join(chars[1:-1])
    return (best[2], [best[1]]) if best[0] >= 2.5 else (text, [])


_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")


def repair(text: str, western: bool = True) -> Repair | None:
    """The repaired text and the pages it was misread in, or None where nothing is wrong. Without `western`, Western
    text of one Western page read as another stays as it is: its letters are as many, if not the right ones.

    `lost` says that some characters can't be recovered: they stand as U+FFFD, or as they stood.
    """
    if text.isascii():
        return None
    pages: list[str] = []
    fixed = text
    fixed, found = _single(fixed)
    pages += [f"{p} as cp1252" for p in found if p != "unknown"]
    unknown = "unknown" in found
    fixed, found = _cyrillic(fixed)
    pages += [f"{p} as cp1251" for p in found]
    for _ in range(4):
        fixed, found = _multibyte(fixed)
        if not found:
            break
        pages += [f"utf-8 as {p}" for p in found]
    if western and not unknown:
        fixed, found = _western(fixed)
        pages += [f"cp1252 as {p}" for p in found]
    lost = LOST in fixed or unknown or bool(_CONTROL.search(fixed))
    if not pages and not lost:
        return None
    return Repair(fixed, tuple(dict.fromkeys(pages)), lost)


REPAIRS = "chunk_id bigint, text_no int, status string, pages array<string>, repaired string"


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, nos, texts = (batch.column(c).to_pylist() for c in ("chunk_id", "text_no", "text"))
        rows = [(i, n, r) for i, n, t in zip(ids, nos, texts) if (r := repair(t))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _, _ in rows], pa.int64()),
                pa.array([n for _, n, _ in rows], pa.int32()),
                pa.array(
                    ["lost" if not r.pages else "partial" if r.lost else "recovered" for _, _, r in rows], pa.string()
                ),
                pa.array([list(r.pages) for _, _, r in rows], pa.list_(pa.string())),
                pa.array([r.text for _, _, r in rows], pa.string()),
            ],
            names=["chunk_id", "text_no", "status", "pages", "repaired"],
        )


def repair_elements(chunks: DataFrame) -> DataFrame:
    """One row for each damaged element of ``chunks.texts`` (see :data:`REPAIRS`).

    `status` is recovered, partial (some characters stay lost) or lost. Nulls, empty texts and texts of nothing
    but ASCII, which no decoder damages, give no rows; a chunk delivered again counts once.
    """
    found = text_elements(chunks, keep=F.length("text") < F.octet_length("text")).mapInArrow(_repairs, REPAIRS)
    return once(found, "chunk_id", "text_no")


def damaged_found(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text_no) of the damaged elements."""
    return repair_elements(chunks).select("chunk_id", "text_no")
