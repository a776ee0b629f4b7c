"""Text functions as column expressions; lengths are in code points throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when a text is trimmed.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A text with none of these needs no work: letters, and numbers other than decimal digits.
WORTH = r"[\p{L}\p{Nl}\p{No}]"
# Arabic letters and their Persian forms, ASCII and Arabic digits and the Persian ones.
LETTERS = ("يكى", "یکی")
DIGITS = ("0123456789٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹۰۱۲۳۴۵۶۷۸۹")


def strip(text: Column) -> Column:
    """`text` without white space, Unicode's included, at its ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def leading(text: Column) -> Column:
    """The white space a text begins with."""
    return F.regexp_extract(text, rf"^[{SPACE}]*", 0)


def trailing(text: Column) -> Column:
    """The white space a text ends with; empty where the text is nothing else."""
    return F.regexp_extract(text, rf"(?s)[^{SPACE}]([{SPACE}]*)\z", 1)


def is_translatable(text: Column) -> Column:
    """Whether a text has anything to render: false for null, blanks, digits and punctuation alone."""
    return F.coalesce(F.rlike(text, F.lit(WORTH)), F.lit(False))


def normalize_persian(text: Column, digits: Column | bool = False) -> Column:
    """Arabic letter forms as Persian ones, and where `digits` holds, digits as well."""
    plain = F.translate(text, *LETTERS)
    if isinstance(digits, bool):
        return F.translate(plain, *DIGITS) if digits else plain
    return F.when(digits, F.translate(plain, *DIGITS)).otherwise(plain)


def segment_hash(text: Column) -> Column:
    """The key under which a rendered text is kept: SHA-1 of its UTF-8 bytes, in hex."""
    return F.sha1(text)


def file_hash(content: Column) -> Column:
    """The first 20 hex digits of a file's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 20)


def extension(filename: Column) -> Column:
    """A file name's ending with its dot, in lower case; empty if it has none."""
    return F.lower(F.regexp_extract(filename, r"(?s)[^/\\.][^/\\]*?(\.[^./\\]*)$", 1))


def output_name(filename: Column, mode: Column, out_extension: Column) -> Column:
    """What a job's result is called: ``base.fa.ext``, or ``base.refined.fa.ext`` for a polished one."""
    base = F.regexp_replace(filename, r"(?<=[^/\\.])\.[^./\\]*$", "")
    polished = mode.isin("refine", "review")
    return F.when(polished, F.concat(F.regexp_replace(base, r"\.fa$", ""), F.lit(".refined.fa"), out_extension)).otherwise(
        F.concat(base, F.lit(".fa"), out_extension)
    )


def duration(seconds: Column) -> Column:
    """Seconds as ``1h 2m``, ``3m 4s`` or ``5s``, cut to whole seconds, at least 0."""
    s = F.greatest(F.lit(0).cast("long"), seconds.cast("long"))
    part = lambda c, unit: F.concat(c.cast("long").cast("string"), F.lit(unit))
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(s >= 3600, F.concat_ws(" ", part(hours, "h"), part(minutes, "m")))
        .when(s >= 60, F.concat_ws(" ", part(F.floor(s / 60), "m"), part(s % 60, "s")))
        .otherwise(part(s, "s"))
    )
