"""Defective pairs of a source and its answer, by a label model over noisy labelling functions.

Each defect has several labelling functions, which vote 1 (defect), -1 (sound) or 0 (no opinion) on a pair. The
votes of all pairs are counted by pattern, which is a table of bounded size, and an expectation-maximization
label model learns from it, without any labels, how far each function is to be trusted and how frequent the
defect is. A pair keeps every defect whose posterior exceeds its cutoff.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstream.llm.encoding import repair
from leafstream.llm.languages import identify, script_counts, survey
from leafstream.llm.values import once
from leafstream.sources.shared import settle

#: By falling precedence, where a pair is to have one defect.
DEFECTS = ("empty", "refusal", "copied", "wrong_language", "truncated")
#: Posteriors above which a defect is kept; tests/llm/test_pairs.py validates them on planted defects.
CUTOFFS = {"empty": 0.5, "refusal": 0.5, "copied": 0.5, "wrong_language": 0.5, "truncated": 0.9}
#: The length at which the run clips sources and answers.
CLIP = 6000

_MARKER = re.compile(r"<<<\s*\d+\s*>>>")
_FENCE = re.compile(r"```[\w+-]*")
_INVISIBLE = re.compile("[\xad\u200b\u200d-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufe0f\ufeff]")
_ACCENTS = re.compile("[\\u0300-\\u036f\\u064b-\\u065f\\u0670]")
_NO_LETTERS = re.compile(r"[\W_]+")
_FORMS = str.maketrans("يىك٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "ییک01234567890123456789")


def core(text: str) -> str:
    """A text without segment markers, code fences and invisible characters but non-joiners."""
    if "<<<" in text:
        text = _MARKER.sub(" ", text)
    if "```" in text:
        text = _FENCE.sub(" ", text)
    return text if text.isascii() else _INVISIBLE.sub("", text)


def _plain(text: str) -> str:
    if text.isascii():
        return text.casefold()
    return _ACCENTS.sub("", unicodedata.normalize("NFKD", text)).translate(_FORMS).casefold()


def _letters(text: str) -> int:
    return len(_NO_LETTERS.sub("", text))


def _numbers(text: str) -> list[str]:
    return [n if n.isascii() else n.translate(_FORMS) for n in _NUMBER.findall(text)]


def _grams(text: str) -> Counter[str]:
    letters = re.sub(r"[\W_]+", "", text)
    size = 2 if len(re.findall("[㐀-鿿]", letters)) * 2 > len(letters) else 5
    if len(letters) <= size:
        return Counter([letters] if letters else [])
    return Counter(letters[i : i + size] for i in range(len(letters) - size + 1))


#: What may stand around a returned source: a few words that say what it is, as their letters alone.
_FRAME = re.compile(
    r"(?:(?:sure|certainly|ofcourse)?(?:(?:here(?:is|s)|thisis)?(?:the|your|my)?(?:persian|farsi)?(?:translation|translatedtext|output|answer|result)(?:(?:into|to|in)(?:persian|farsi))?"
    r"(?:ofthe(?:text|passage|source))?(?:is|follows)?|hereitis|hereyouare)"
    r"|(?:hieristdie|die)?ubersetzung|(?:voicila|la)?traduction|(?:aquiestala|la)?traduccion|(?:اینهم|این)?ترجمه(?:متن|فارسی)?)?"
)


def _framed(answer: str, source: str) -> bool:
    """Whether the source's letters stand whole in the answer, with nothing else but a known frame before or after them."""
    own, whole = (_NO_LETTERS.sub("", _plain(t)) for t in (source, answer))
    if not own or not any(c.isalpha() for c in own):
        return False
    if whole.startswith(own) and _FRAME.fullmatch(whole, len(own)):
        return True
    return len(whole) - len(own) < 200 and whole.endswith(own) and bool(_FRAME.fullmatch(whole, 0, len(whole) - len(own)))


def _overlap(answer: str, source: str, mine: dict[str, int], theirs: dict[str, int]) -> tuple[float, float, float]:
    """What part of the answer is in the source, of the source in the answer, and the part that tells a copy.

    Of the source no more can stand in the answer than the answer has letters of its scripts: where that bounds the
    parts below what any function votes on, they count as the bound and 0. Very short texts are copies only if they
    are the same, or the source in a frame."""
    whole = sum(theirs.values())
    if whole and sum(min(mine[k], theirs[k]) for k in mine) / whole < 0.2:
        return 0.0, 0.0, 0.0
    if _framed(answer, source):
        return 1.0, 1.0, 1.0
    a, b = _grams(_plain(answer)), _grams(_plain(source))
    n, m = sum(a.values()), sum(b.values())
    shared = sum((a & b).values())
    of_answer, of_source = shared / max(1, n), shared / max(1, m)
    if n < 16 and min(of_answer, of_source) < 1:
        return of_answer, of_source, 0.0
    return of_answer, of_source, max(of_answer, of_source)


# ---- refusals ----------------------------------------------------------------------------------------------

# How answers decline, and what they call the task.
_DECLINE = re.compile(
    r"can'?t\b|cannot|can not|unable|not able|won'?t\b|not something i can|declin|refus|falls? outside|against my|"
    r"no translation will|not (?:permitted|allowed|possible)|"
    r"نمی ?توان|معذور|خودداری|مجاز به|مجاز نیست|اجازه|در توان من|سازگار نیست|امکان ترجم|قادر نیست|امتناع|پوزش|"
    r"ne (?:peux|puis|suis) pas|impossible|incapable|refuse|"
    r"kann .{0,60}nicht|leider nicht|nicht moglich|ablehn|verweiger|"
    r"no (?:me es|es) posible|no puedo|no podemos|lamento|"
    r"не могу|невозможно|отказ|لا استطيع|لا استطیع|لا یمکننی|اعتذر|غیر قادر|无法|不能|拒绝"
)
_TASK = re.compile(
    r"translat|traduc|traduire|[uü]bersetz|перевод|перевест|翻译|ترجم|request|anfrage|solicitud|درخواست|"
    r"language model|مدل زبان|content|محتوا|instruction|دستورالعمل|policy|guideline|safety|"
    r"excerpt|passage|fragment|material|this (?:one|part|text)|قطعه|این بخش|این متن|version"
)
_SORRY = re.compile(
    r"sorry|apolog|regret|unfortunately|to be transparent|as an? (?:ai|language)|desole|leider|lo lamento|"
    r"متاسف|ببخشید|پوزش|به عنوان یک مدل|لطفا|please provide|let me know|\(policy\)|抱歉|извините|простите"
)

# What only the task is called, and how a speaker declines: enough at any place of an answer.
_TRANSLATING = re.compile(r"translat|traduc|traduire|[uü]bersetz|перевод|перевест|翻译|ترجم|language model|مدل زبان")
_I_DECLINE = re.compile(
    r"\bi (?:really |simply |also )?(?:can'?t|cannot|can not|won'?t|am unable|am not able|(?:must|have to) (?:decline|refuse))|"
    r"\bi'm (?:unable|not able|not permitted|not allowed)|"
    r"نمی ?توان(?:م|یم)|معذورم|قادر نیستم|مجاز نیستم|خودداری می ?کنم|"
    r"je ne (?:peux|puis|suis) pas|ich kann .{0,60}nicht|no (?:puedo|podemos)|не могу|لا استطیع|لا یمکننی|我(?:无法|不能)"
)
#: How far from each other, at most, the words for declining and for the task stand.
_APART = 200

# ---- ends and units ----------------------------------------------------------------------------------------

_QUOTED = re.compile("“[^“”„]*”|«[^«»]*»|„[^„“”]*[“”]|‘[^‘’]{8,}’|\"[^\"\\n]*\"|—[^—\\n]*—")
_STOP = re.compile("[.!?。！？؟۔…]+[»”\"'’)\\]]*")
_SENTENCE = re.compile("[^.!?。！？؟۔…\n]*\\w[^.!?。！？؟۔…\n]*")
_STOPPED = re.compile("[.!?。！？؟۔»”\"'’)\\]]\\s*$")
_OPEN_END = re.compile("[…\\[(«“\\-،,:]\\s*$|\\.\\.\\.\\s*$")
_NUMBER = re.compile(r"\d+")
#: From the first letter on, up to the next stop or line end.
_STATEMENT = re.compile("[\\w¤][^.!?。！？؟۔…\n]*")
_QUOTES = re.compile("[“«„‘\"—]").search
_SAID = re.compile(r":\s*¤\s*")


def units(text: str) -> int:
    """How many statements a text makes: sentences, with a quotation and who said it as one."""
    if not _QUOTES(text):
        return len(_STATEMENT.findall(text))
    total = 0
    for line in text.split("\n"):
        if _QUOTES(line):
            line = _QUOTED.sub(" ¤ ", line.strip())
            if "¤" in line:
                line = _SAID.sub(" ¤. ", line)
        total += len(_STATEMENT.findall(line))
    return total


def _near(first: re.Pattern[str], second: re.Pattern[str], said: str) -> bool:
    return any(second.search(said, max(0, m.start() - _APART), m.end() + _APART) for m in first.finditer(said))


def declining(text: str) -> tuple[int, int] | None:
    """Where a text, outside its quotations, first says that it declines the task: in a sentence, or two in a row."""
    if not _TASK.search(text.replace("\u200c", "").casefold().replace("ي", "ی")):
        return None
    plain = _QUOTED.sub(" ¤ ", text) if _QUOTES(text) else text
    if not _letters(plain.replace("¤", "")):
        plain = text
    before = ""
    for m in _SENTENCE.finditer(plain):
        said = re.sub(r"\s+", " ", _plain(m.group().replace("\u200c", "")).replace("’", "'"))
        if _near(_DECLINE, _TRANSLATING, f"{before} {said}") or _near(_I_DECLINE, _TASK, said):
            return m.span()
        before = said
    return None


class Pair:
    """What the labelling functions look at. Each looks for itself: none knows how another has voted."""

    def __init__(self, source: str | None, answer: str | None):
        self.raw_source, self.raw = source or "", answer or ""
        fixed = repair(self.raw_source, western=False)
        self.source, self.text = core(fixed.text if fixed else self.raw_source), core(self.raw)
        self.counts, self.letters = survey(self.text)
        self.source_counts, self.source_letters = survey(self.source)
        self.language, self.evidence = identify(self.text, self.counts)
        self.origin, _ = identify(self.source, self.source_counts)
        known = sum(self.counts.values())
        self.persian_share = self.counts["arabic"] / known if known else 0.0
        self.units, self.source_units = units(self.text), units(self.source)
        self.numbers, self.own_numbers = _numbers(self.source), set(_numbers(self.text))
        self.clipped = len(self.raw_source) >= CLIP - 12

    @cached_property
    def overlap(self) -> tuple[float, float, float]:
        return _overlap(self.text, self.source, self.counts, self.source_counts)

    @cached_property
    def declined(self) -> tuple[int, int] | None:
        """Where the answer declines, unless its source does so too, which it then renders."""
        found = declining(self.text)
        return None if found is None or declining(self.source) is not None else found

    @cached_property
    def opening(self) -> tuple[bool, bool, bool]:
        """Whether the first words of the answer speak of the task, decline, and apologize: a short answer may do so in
        words too weak to count anywhere."""
        start = self.text[:480].replace("\u200c", "")
        if not _TASK.search(start.casefold().replace("ي", "ی")):
            return False, False, False
        head = re.sub(r"\s+", " ", _plain(start).replace("’", "'"))
        declines = _DECLINE.search(head[:240])
        # words that the source has itself are repeated, not said
        own = declines and declines.group() not in _plain(self.source).replace("’", "'")
        return True, bool(own), bool(_SORRY.search(head[:400]))

    @cached_property
    def rendering(self) -> str:
        """The answer without what it says about itself; a refusal with little beside it has none."""
        if self.declined is None and not (self.opening[1] and len(self.text) <= 420):
            return self.text
        start, end = self.declined or (0, len(self.text))
        rest = self.text[:start] if start > len(self.text) - end else self.text[end:]
        return rest if _letters(rest) > 0.2 * self.source_letters and units(rest) > 1 else ""

    @cached_property
    def spoken(self) -> tuple[str, float, float]:
        """The language of the rendering, the evidence for it, and its share of Persian letters."""
        if self.rendering is self.text:
            return self.language, self.evidence, self.persian_share
        counts = script_counts(self.rendering)
        return *identify(self.rendering, counts), counts["arabic"] / max(1, sum(counts.values()))

    @cached_property
    def open_end(self) -> bool | None:
        """Whether the answer breaks off where its source doesn't; None where neither end says anything."""
        text = self.rendering
        stopped = bool(_STOPPED.search(text)) and not re.search("[\\[(«“]\\s*$", text)
        tail = text.rstrip().rsplit("\n", 1)[-1].rsplit("—", 1)[-1]
        heading = len(tail) < 30 and bool(re.search(r"\w\s*\d+\s*$", tail))
        leads_on = bool(re.search("[:;,،—–-]\\s*$", self.source))
        ended = bool(_STOPPED.search(self.source) or self.source_units > 1) and not leads_on
        if self.clipped:
            return None
        if not stopped and not heading and ended or _OPEN_END.search(text) and not leads_on:
            return True
        return False if stopped or heading else None


# ---- labelling functions: 1 for the defect, -1 against it, 0 without an opinion --------------------------------


def _sign(yes: bool | None, no: bool | None = None) -> int:
    """1, else -1 (where `no` is given, only if it holds), else 0."""
    return 1 if yes else -1 if no or no is None else 0


def _shorter(p: Pair) -> int:
    """Beside a longer source, an answer of almost no letters says nothing."""
    return _sign(p.letters * 50 < p.source_letters, p.letters >= 2 and p.source_letters >= 50)


def _content(p: Pair) -> int:
    """An answer with the source's numbers, or with as many statements, carries the task out."""
    shared = bool(p.own_numbers.intersection(p.numbers))
    return -1 if shared or p.units > 5 and p.units >= 0.7 * p.source_units else 0


def _size_of_refusal(p: Pair) -> int:
    """Refusals are short, whatever the source; only one that speaks of the task is told by its length, though."""
    task, declines, sorry = p.opening
    if len(p.text) > 420:
        return 0 if p.declined else -1
    return 0 if len(p.text) > 260 else _sign(p.declined is not None or task and (declines or sorry), False)


def _place_of_refusal(p: Pair) -> int:
    """Where an answer declines: at its beginning it is surest, and late is no evidence against it."""
    if p.declined is None:
        return _sign(False, not (p.opening[1] and len(p.text) <= 420))
    return 1 if p.declined[0] < 240 else 0


def _both_ways(p: Pair) -> int:
    of_answer, of_source, _ = p.overlap
    return _sign(min(of_answer, of_source) >= 0.5, max(of_answer, of_source) <= 0.3)


def _whole_lines(p: Pair) -> int:
    """The source's longest lines, as they stand in it."""
    if not p.overlap[2]:
        return -1
    lines = sorted((x.strip() for x in p.source.split("\n")), key=len)[-3:]
    lines = [x for x in lines if len(x) >= 20]
    found = sum(x in p.text for x in lines)
    return 0 if not lines else _sign(found == len(lines), found == 0 and p.overlap[2] < 0.4)


def _foreign_words(p: Pair) -> int:
    """The short words of a language that is neither Persian nor the source's."""
    language, evidence, _ = p.spoken
    foreign = language not in ("fa", "", p.origin)
    return _sign(foreign and evidence >= 2, not foreign)


def _foreign_script(p: Pair) -> int:
    """Hardly any letter of the Persian script; Arabic, which shares it, is told by its words."""
    language, _, share = p.spoken
    return _sign(share < 0.2 or language == "ar", share > 0.6 and language == "fa")


def _foreign_content(p: Pair) -> int:
    """What is in neither language shares little with its source."""
    language, evidence, _ = p.spoken
    if language in ("fa", p.origin) or p.overlap[2] >= 0.5:
        return -1
    return _sign(evidence >= 1 and p.overlap[2] < 0.4, False)


def _statements(p: Pair) -> int:
    """The share of the source's statements that the answer has."""
    share = units(p.rendering) / max(1, p.source_units) if p.rendering is not p.text else p.units / max(1, p.source_units)
    return 0 if p.source_units < 3 and share >= 0.5 else _sign(share < 0.7, share >= 0.8)


def _late_numbers(p: Pair) -> int:
    """The numbers of the source's second half."""
    late = set(p.numbers[len(p.numbers) // 2 :]) if len(p.numbers) >= 2 else set()
    return 0 if not late else _sign(not late & p.own_numbers and not p.clipped, bool(late & p.own_numbers))


_FUNCTIONS: dict[str, tuple[Callable[[Pair], int], ...]] = {
    "empty": (
        lambda p: _sign(p.letters == 0),
        lambda p: _sign(not p.text.strip(), p.letters >= 2),
        _shorter,
    ),
    "refusal": (
        lambda p: _sign(p.declined is not None or p.opening[1] and len(p.text) <= 420),
        lambda p: _sign(p.declined is not None or p.opening[0] and (p.opening[1] or p.opening[2]) and len(p.text) <= 420),
        _place_of_refusal,
        _size_of_refusal,
        _content,
    ),
    "copied": (
        lambda p: _sign(p.overlap[2] >= 0.7, p.overlap[2] <= 0.4),
        _both_ways,
        _whole_lines,
        lambda p: _sign(bool(p.language) and p.language == p.origin, p.language == "fa"),
    ),
    "wrong_language": (_foreign_words, _foreign_script, _foreign_content),
    "truncated": (_statements, lambda p: 0 if p.open_end is None else _sign(p.open_end), _late_numbers),
}


def measure(source: str | None, answer: str | None) -> dict[str, object]:
    """The votes on one pair, by defect, and what the vote on its length needs.

    A function has no opinion on what isn't there: nothing is declined, copied or rendered by an answer without
    letters, a Persian source may be returned, and only renderings can stop early or be in the wrong language.
    """
    p = Pair(source, answer)
    renders = bool(p.letters and p.rendering)
    in_persian = renders and p.spoken[0] == "fa" and p.spoken[2] > 0.5 and len(p.raw) < CLIP - 12
    asked = {"empty": True, "refusal": p.letters, "copied": p.letters and p.origin != "fa", "wrong_language": renders, "truncated": in_persian}
    votes = {d: [f(p) for f in functions] if asked[d] else [0] * len(functions) for d, functions in _FUNCTIONS.items()}
    letters = p.letters if p.rendering is p.text else _letters(p.rendering)
    ratio = math.log(letters / p.source_letters) if in_persian and letters and p.source_letters >= 12 else None
    return {"votes": votes, "origin": p.origin, "ratio": ratio}


_CODE = {-1: "-", 0: "0", 1: "+"}
MEASURES = "part_id bigint, origin string, ratio double, " + ", ".join(f"{d} string" for d in DEFECTS)


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sources, answers = (batch.column(c).to_pylist() for c in ("part_id", "source", "translation"))
        seen = [measure(s, a) for s, a in zip(sources, answers)]
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([m["origin"] for m in seen], pa.string()),
            pa.array([m["ratio"] for m in seen], pa.float64()),
        ] + [pa.array(["".join(_CODE[v] for v in m["votes"][d]) for m in seen], pa.string()) for d in DEFECTS]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MEASURES.split(", ")])


def vote(parts: DataFrame) -> DataFrame:
    """(part_id, one vote string per defect): a pair for each part_id; repeated rows count once."""
    measured = parts.where(F.col("part_id").isNotNull()).select("part_id", "source", "translation")
    measured = settle(once(measured.mapInArrow(_measures, MEASURES), "part_id"), "votes")
    # a rendering's usual length for its source language, over all pairs; few languages, so few rows
    usual = measured.where(F.col("ratio").isNotNull()).groupBy("origin").agg(
        F.percentile_approx("ratio", 0.5, 1000).alias("usual")
    )
    short = F.col("ratio") - F.col("usual")
    length = (
        F.when(F.col("ratio").isNull() | F.col("usual").isNull(), "0")
        .when(short < math.log(0.55), "+")
        .when(short > math.log(0.75), "-")
        .otherwise("0")
    )
    joined = measured.join(F.broadcast(usual), "origin", "left")
    return joined.select("part_id", *DEFECTS[:-1], F.concat("truncated", length).alias("truncated"))


def learn(patterns: dict[str, int], prior: float = 0.05, rounds: int = 60) -> dict[str, float]:
    """The posterior of a defect for each vote pattern, given how often each occurs.

    The functions are taken as independent given the truth, and one without an opinion as no evidence. Each
    starts as mostly right, as if some pairs more had voted so, which keeps what is rare from drifting. Pairs on
    which no function has an opinion teach nothing, and have no defect.
    """
    names = sorted(n for n in patterns if n.strip("0"))
    silent = {n: 0.0 for n in patterns if not n.strip("0")}
    if not names:
        return silent
    counts = np.array([patterns[n] for n in names], dtype=float)
    votes = np.array([[{"-": 0, "0": -1, "+": 1}[c] for c in n] for n in names])
    start = np.array([[0.97, 0.03], [0.12, 0.88]])  # truth x vote
    theta = np.repeat(start[None], votes.shape[1], axis=0)
    pseudo = (5.0 + 0.02 * counts.sum() * np.array([[1.0], [prior]])) * start
    share = prior
    posterior = np.zeros(len(names))
    for _ in range(rounds):
        odds = np.full(len(names), np.log(share / (1 - share)))
        for f in range(votes.shape[1]):
            ratio = np.log(theta[f, 1] / theta[f, 0])
            odds += np.where(votes[:, f] < 0, 0.0, ratio[votes[:, f]])
        posterior = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        weight = np.stack([counts * (1 - posterior), counts * posterior], axis=1)
        for f in range(votes.shape[1]):
            for v in range(2):
                theta[f, :, v] = weight[votes[:, f] == v].sum(axis=0) + pseudo[:, v]
            theta[f] /= theta[f].sum(axis=1, keepdims=True)
        share = (weight[:, 1].sum() + 1) / (counts.sum() + 20)
    return silent | dict(zip(names, posterior.tolist()))


def posteriors(votes: DataFrame) -> DataFrame:
    """(part_id, defects: map of each defect to its posterior)."""
    spark = votes.sparkSession
    stacked = votes.select(F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("p")) for d in DEFECTS])))
    # at most 3 to the power of a defect's functions
    counted = stacked.groupBy("col.d", "col.p").count().collect()
    rows = []
    for d in DEFECTS:
        rows += [(d, p, q) for p, q in learn({r["p"]: r["count"] for r in counted if r["d"] == d}).items()]
    out = votes
    for d in DEFECTS:
        own = [(p, q) for e, p, q in rows if e == d]
        known = spark.createDataFrame(own, f"{d} string, p_{d} double")
        out = out.join(F.broadcast(known), d, "left")
    return out.select("part_id", *[F.col(f"p_{d}") for d in DEFECTS])


def label_pairs(parts: DataFrame, cutoffs: dict[str, float] = CUTOFFS) -> DataFrame:
    """(part_id, defects, defect, p_...): all defects of each pair, the first by precedence, and posteriors.

    A sound pair has an empty array and a null defect. A null or blank answer is empty; a null source counts as
    an empty text, against which nothing is copied or truncated. Rows without part_id are left out, and repeated
    rows count once.
    """
    judged = posteriors(vote(parts))
    kept = F.filter(
        F.array(*[F.when(F.col(f"p_{d}") > cutoffs[d], F.lit(d)) for d in DEFECTS]), lambda x: x.isNotNull()
    )
    judged = judged.withColumn("defects", kept)
    return judged.select("part_id", "defects", F.get("defects", F.lit(0)).alias("defect"), *[f"p_{d}" for d in DEFECTS])


def defects_found(parts: DataFrame) -> DataFrame:
    """(part_id, defect) of the defective pairs."""
    return label_pairs(parts).where(F.col("defect").isNotNull()).select("part_id", "defect")
