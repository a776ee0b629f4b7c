"""Prompts and answers: segments behind numbered markers, and back.

A run may bring system prompts of its own; nothing here depends on their wording.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafstream.functions.text import SPACE, strip

#: A marker on a line of its own; (?md): lines end at a newline only, and white space may stand around the number.
MARKER = rf"(?md)^[ \t]*<<<[{SPACE}]*(\p{{Nd}}+)[{SPACE}]*>>>[ \t]*$"
_DIGITS = ("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩０１２３４５６７８９", "0123456789" * 3)

#: System prompts by mode, for runs that bring none.
BASE = {
    "translate": (
        "You render texts into Persian. Give the whole of each text in clear, natural Persian of the same tone, leaving "
        "nothing out and adding nothing. Keep numbers, names, links, code and line breaks. Texts may stand under lines such "
        "as <<<1>>>: repeat each such line as it is, in the same order, with its text's rendering below it. Answer with "
        "nothing but the rendering."
    ),
    "refine": (
        "You polish Persian texts that were translated. Mend grammar, wording, spelling and half-spaces so that they read as "
        "if written in Persian, and keep the sense, the order and the line breaks. Texts may stand under lines such as "
        "<<<1>>>: repeat each such line as it is, in the same order, with its polished text below it. Answer with nothing "
        "but the texts."
    ),
}
EXTRA = "\n\nThe user also asks for this:\n"


def instructed(base: str, extra: str) -> str:
    """A base prompt with the user's own instructions, if there are any."""
    return base + EXTRA + extra.strip() if extra.strip() else base


def user_prompt(texts: Column) -> Column:
    """One text as it is; several each under its marker, numbered from 1. Null elements count as empty."""
    marked = F.transform(
        texts,
        lambda t, i: F.concat(F.lit("<<<"), (i + 1).cast("string"), F.lit(">>>\n"), F.coalesce(t, F.lit(""))),
    )
    return F.when(F.size(texts) == 1, F.coalesce(texts[0], F.lit(""))).otherwise(F.array_join(marked, "\n"))


def base_prompt(mode: Column) -> Column:
    """The built-in prompt of a run's mode."""
    return F.when(mode.isin("refine", "review"), F.lit(BASE["refine"])).otherwise(F.lit(BASE["translate"]))


def system_prompt(base: Column, extra: Column) -> Column:
    """The base prompt, followed by the user's own instructions if there are any."""
    extra = strip(F.coalesce(extra, F.lit("")))
    return F.when(extra == "", base).otherwise(F.concat(base, F.lit(EXTRA), extra))


def parse_response(answer: Column, expected: Column) -> Column:
    """The texts of an answer, or null where its markers are not exactly 1 to `expected`, in order, with a text each.

    A single text may come with or without marker lines and may be empty; what precedes the first of several
    markers is dropped.
    """
    single = F.array(strip(F.regexp_replace(answer, MARKER, "")))
    numbers = F.transform(
        F.regexp_extract_all(answer, F.lit(MARKER), 1), lambda n: F.try_to_number(F.translate(n, *_DIGITS), F.lit("9" * 18))
    )
    wanted = F.transform(F.sequence(F.lit(1), F.greatest(expected, F.lit(1))), lambda i: i.cast("decimal(18,0)"))
    bodies = F.transform(F.slice(F.split(answer, MARKER, -1), F.lit(2), F.greatest(expected, F.lit(1))), strip)
    good = (numbers == wanted) & ~F.exists(bodies, lambda b: b == "")
    return F.when(expected == 1, single).when(F.coalesce(good, F.lit(False)), bodies)


def clean_output(text: Column) -> Column:
    """An answer without reasoning blocks and without a code fence around the whole of it."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<(think|thinking|reasoning)>.*?</\1>", "")
    stray = F.locate("</think>", text)
    text = F.when(stray > 0, F.substring(text, stray + F.lit(8), F.length(text))).otherwise(text)
    bare = strip(text)
    inside = F.substring(bare, F.lit(4), F.greatest(F.length(bare) - 6, F.lit(0)))
    line = F.locate("\n", inside)
    inside = F.when(line > 0, F.substring(inside, line + F.lit(1), F.length(inside))).otherwise(inside)
    fenced = F.startswith(bare, F.lit("```")) & F.endswith(bare, F.lit("```"))
    return F.regexp_replace(F.when(fenced, inside).otherwise(bare), r"^\n+|\n+\z", "")
