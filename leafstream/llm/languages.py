"""A small language identifier: the script of the letters, and the usual short words of each language."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

# The usual short words of each language.
_SHORT = {
    "en": "the of and to in is was were it that for on with as at by this be are from or an not no i you he his her "
    "said after before behind under beside along away there where when what who will would could should can my",
    "fr": "le la les de des du et en un une est à au aux dans pour sur par pas que qui ne se sa son ses avec sous "
    "près derrière après avant dit il elle ce cette plus tard même fois",
    "de": "der die das den dem des und in ein eine einen einem ist zu von mit auf für nicht sich es an am im nach vor "
    "unter hinter neben sagte als auch aus bei war wieder einmal dieser ihre seine",
    "es": "el la los las de del y en un una es a al que por con no se su sus para lo como más junto bajo detrás tras "
    "después antes dijo durante este esta ha había cerca",
    "fa": "را در از به که این آن با پس کرد گفت روز بار دیگر می شد بود برد زیر روی پشت کنار نزدیک پیش یک برای تا هر "
    "خود است نیست میان همان سر بر یا هم نه چه اگر شب",
    "ar": "في من على إلى عن أن قال بعد قبل خلف تحت عند قرب هذا هذه كان التي الذي لا ما لم مع ثم أو بين كل ذلك إن "
    "فوق ساعة يوم اليوم منذ دون مرة",
    "ru": "и в не на с что по из за под у как он она это был к до от для при после через сказал уже ещё раз",
    "zh": "的 了 在 是 我 他 她 不 们 这 那 着 和 有 说 里 后 上 下 到",
}
WORDS = {lang: frozenset(words.split()) for lang, words in _SHORT.items()}

_LATIN_LANGUAGES = ("en", "fr", "de", "es")
_LATIN_SHORT = frozenset().union(*(WORDS[lang] for lang in _LATIN_LANGUAGES))
_ARTICLE = re.compile(r"\bال[^\W\d_]{3}")
# Letters of Persian that Arabic has not, and of Arabic that Persian has not.
_PERSIAN_ONLY = re.compile("[پچژگ‌]")
_ARABIC_ONLY = re.compile("[ةأإ]")


def _persian_forms(text: str) -> str:
    return text.replace("ي", "ی").replace("ى", "ی").replace("ك", "ک")


_FA = frozenset(map(_persian_forms, WORDS["fa"]))
_AR = frozenset(map(_persian_forms, WORDS["ar"]))


_SCRIPTS = ("arabic", "latin", "cyrillic", "han")


def _script_table() -> np.ndarray:
    """The script of each character of the first plane, 0 for none of them."""
    table = np.zeros(0x10000, dtype=np.uint8)
    spans = {1: ("ءغ", "في", "ٱۓ"), 2: ("AZ", "az", "Àɏ"), 3: ("Ѐӿ",), 4: ("㐀鿿",)}
    for script, pairs in spans.items():
        for low, high in pairs:
            table[ord(low) : ord(high) + 1] = script
    return table


_SCRIPT_OF = _script_table()


_WORDED = np.array([bool(re.match(r"[^\W_]", chr(c))) for c in range(0x10000)])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _by_script(codes: np.ndarray) -> dict[str, int]:
    found = np.bincount(_SCRIPT_OF[np.minimum(codes, 0xFFFF)], minlength=5).tolist()
    return {script: found[no] * (2 if script == "han" else 1) for no, script in enumerate(_SCRIPTS, 1)}


def script_counts(text: str) -> dict[str, int]:
    """Letters by script; a Chinese character counts as two."""
    return _by_script(_codes(text))


def survey(text: str) -> tuple[dict[str, int], int]:
    """The letters by script, and how many letters and digits there are in all."""
    codes = _codes(text)
    beyond = codes > 0xFFFF
    letters = int(np.count_nonzero(_WORDED[np.minimum(codes, 0xFFFF)]))
    if beyond.any():
        letters += sum(chr(c).isalnum() for c in codes[beyond].tolist())
    return _by_script(codes), letters


def identify(text: str, counts: dict[str, int] | None = None) -> tuple[str, float]:
    """(language, evidence): the language that most speaks for, "" if nothing does; evidence is the number of
    short words by which it leads, large where the script alone decides."""
    counts = counts or script_counts(text)
    script, most = max(counts.items(), key=lambda x: x[1])
    if not most:
        return "", 0.0
    if script == "cyrillic":
        return "ru", 9.0
    if script == "han":
        return "zh", 9.0
    if script == "arabic":
        persian, arabic = len(_PERSIAN_ONLY.findall(text)), len(_ARABIC_ONLY.findall(text)) + len(_ARTICLE.findall(text))
        if persian >= 6 and persian > 3 * arabic:
            return "fa", float(persian)
        words = Counter(_persian_forms(text).replace("‌", " ").split())
        fa = sum(words[w] for w in words.keys() & _FA) + persian / 2
        ar = sum(words[w] for w in words.keys() & _AR) + arabic / 2
        return ("fa", fa - ar) if fa >= ar else ("ar", ar - fa)
    # short words hardly ever stand next to a mark
    words = Counter(text.lower().split())
    found = words.keys() & _LATIN_SHORT
    score = lambda lang: sum(words[w] for w in found if w in WORDS[lang])
    scores = sorted(((score(lang), lang) for lang in _LATIN_LANGUAGES), reverse=True)
    return (scores[0][1], float(scores[0][0] - scores[1][0])) if scores[0][0] else ("", 0.0)
