"""Column functions against hand-made cases and against plain Python."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafstream.functions import progress, prompts
from leafstream.functions import providers as P
from leafstream.functions import text as T
from leafstream.sources.plain import translatable


def one(spark, column, **values):
    """The value of a column expression over one row of named values."""
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    frame = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def each(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_translatable(spark):
    cases = {"Hello": True, "12": False, "٣": False, "½": True, "Ⅳ": True, "___": False, "—": False, "": False, " \n": False, "سلام": True, None: False}
    assert each(spark, list(cases), T.is_translatable) == list(cases.values())


def test_translatable_agrees_with_python(spark):
    known = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    found = each(spark, known, T.is_translatable)
    differ = [hex(ord(c)) for c, x in zip(known, found) if x != translatable(c)]
    # Java knows fewer of the letters that came with late Unicode versions
    assert len(differ) < 250 and all(int(c, 16) > 0x500 for c in differ)


def test_strip_is_pythons(spark):
    blanks = [chr(c) for c in range(sys.maxunicode) if chr(c).isspace()]
    cases = ["".join(blanks) + "a b" + "".join(blanks), "", "​ a ​", *[f"{b}x{b}" for b in blanks]]
    assert each(spark, cases, T.strip) == [c.strip() for c in cases]
    assert each(spark, cases, T.leading) == [c[: len(c) - len(c.lstrip())] for c in cases]
    assert each(spark, cases, T.trailing) == [c[len(c.rstrip()) :] if c.strip() else "" for c in cases]


def test_normalize(spark):
    assert one(spark, T.normalize_persian(F.col("t"), True), t="يكى 09٣") == "یکی ۰۹۳"
    assert one(spark, T.normalize_persian(F.col("t")), t="يكى 09٣") == "یکی 09٣"


def test_hashes(spark):
    assert one(spark, T.segment_hash(F.col("t")), t="سلام") == hashlib.sha1("سلام".encode()).hexdigest()
    assert one(spark, T.file_hash(F.col("t").cast("binary")), t="abc") == hashlib.sha256(b"abc").hexdigest()[:20]


@pytest.mark.parametrize(("seconds", "said"), [(3661.0, "1h 1m"), (61.0, "1m 1s"), (9.8, "9s"), (-4.0, "0s"), (7200.0, "2h 0m")])
def test_duration(spark, seconds, said):
    assert one(spark, T.duration(F.col("t")), t=seconds) == said


def test_names(spark):
    name = lambda f, m: one(spark, T.output_name(F.col("f"), F.lit(m), T.extension(F.col("f"))), f=f)
    assert name("b.epub", "translate") == "b.fa.epub"
    assert name("b.fa.epub", "refine") == "b.refined.fa.epub"
    assert name("a.b.txt", "translate") == "a.b.fa.txt"


def test_keys_and_roles(spark):
    assert one(spark, P.split_keys(F.col("k")), k="a, b;a\nc") == ["a", "b", "c"]
    assert one(spark, P.split_keys(F.lit(None).cast("string"))) == []
    roles = lambda t: one(spark, P.parse_roles_text(F.col("t")), t=t)
    assert roles("refine") == ["review"]
    assert roles("t+r") == roles("xyz") == roles("") == roles("both") == ["translate", "review"]
    assert one(spark, P.parse_roles(F.lit(None).cast("array<string>"))) == ["translate", "review"]


def test_urls(spark):
    for url in ("http://h/v1/", "http://h/v1/chat/completions", " http://h/v1 "):
        assert one(spark, P.chat_url(F.col("u")), u=url) == "http://h/v1/chat/completions"
        assert one(spark, P.models_url(F.col("u")), u=url) == "http://h/v1/models"


@pytest.mark.parametrize(
    ("status", "body", "kind"),
    [
        (402, "any", "quota"),
        (429, "quota exceeded per day", "quota"),
        (429, "quota exceeded, requests per minute", "rate_limit"),
        (401, "bad key", "auth"),
        (403, "insufficient credits", "quota"),
        (408, "", "transient"),
        (503, "", "transient"),
        (413, "", "too_large"),
        (400, "maximum context length", "too_large"),
        (400, "insufficient_quota", "quota"),
        (404, "no such model", "fatal"),
    ],
)
def test_error_kinds(spark, status, body, kind):

    assert one(spark, P.error_kind(F.col("s"), F.col("b")), s=status, b=body) == kind
    assert P.kind_by_rules(P.HTTP_RULES, body, status) == kind


def test_pauses(spark):
    none = F.lit(None).cast("double")
    assert [one(spark, P.quota_pause(F.col("n"), none), n=n) for n in (1, 2, 9)] == [1800, 3600, 21600]
    assert [one(spark, P.rate_pause(F.col("n"), none), n=n) for n in (1, 3, 9)] == [10, 40, 120]
    assert [one(spark, P.error_pause(F.col("n")), n=n) for n in (1, 2, 3, 4, 5, 8)] == [3, 6, 12, 24, 120, 120]
    assert one(spark, P.quota_pause(F.col("n"), F.lit(7.0)), n=3) == 7


def test_prompt(spark):
    assert one(spark, prompts.user_prompt(F.col("t")), t=["only"]) == "only"
    assert one(spark, prompts.user_prompt(F.col("t")), t=["a", None, "b"]) == "<<<1>>>\na\n<<<2>>>\n\n<<<3>>>\nb"
    assert one(spark, prompts.system_prompt(F.lit("base"), F.col("e")), e=" ") == "base"
    assert one(spark, prompts.system_prompt(F.lit("base"), F.col("e")), e=" x ").endswith("\nx")


@pytest.mark.parametrize(
    ("answer", "n", "texts"),
    [
        ("<<<1>>>\nA\n<<<2>>>\nB", 2, ["A", "B"]),
        ("intro\n<<<1>>>\nA\n<<<2>>>\nB", 2, ["A", "B"]),
        ("<<<2>>>\nB\n<<<1>>>\nA", 2, None),
        ("<<<1>>>\nA\n<<<2>>>\n", 2, None),
        ("<<<1>>>\r\nA\r\n<<<2>>>\r\nB", 2, None),
        ("<<<۱>>>\nA\n<<<2>>>\nB", 2, ["A", "B"]),
        ("<<<1>>>\nA", 1, ["A"]),
        ("<<<1>>>", 1, [""]),
        ("A", 2, None),
        ("", 2, None),
        ("<<<99999999999999999999999>>>\nA\n<<<2>>>\nB", 2, None),
    ],
)
def test_parse(spark, answer, n, texts):
    assert one(spark, prompts.parse_response(F.col("a"), F.col("n")), a=answer, n=n) == texts


@pytest.mark.parametrize("answer", ["<think>x</think>Hi", "x</think>Hi", "```text\nHi\n```", "\n Hi \n", "<THINKING>a\nb</THINKING>Hi"])
def test_clean(spark, answer):
    assert one(spark, prompts.clean_output(F.col("a")), a=answer) == "Hi"


def test_answers(spark):
    get = lambda raw: one(spark, P.answer(F.col("r")), r=raw)
    assert get('{"choices":[{"message":{"content":"Hi"}}]}')["text"] == "Hi"
    assert get('{"choices":[{"text":"Hi"}]}')["text"] == "Hi"
    assert get('{"choices":[{"message":{"content":[{"text":"H"},{"text":"i"}]}}]}')["text"] == "Hi"
    assert get('{"choices":[{"message":{"content":"Hi"},"finish_reason":"length"}]}')["kind"] == "too_large"
    assert get('{"error":{"message":"invalid api key"}}')["kind"] == "auth"
    assert get("<html>")["kind"] == get("{}")["kind"] == get('{"choices":[{"text":" "}]}')["kind"] == "transient"


def test_progress(spark):
    whole = lambda d, t, f=False: one(spark, progress.percent(F.col("d"), F.col("t"), F.lit(f)), d=d, t=t)
    assert whole(9, 400) == 2.2 and whole(5, 0) == 0 and whole(9, 4) == 100 and whole(1, 9, True) == 100


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab \n<>12", min_size=0, max_size=12), min_size=2, max_size=5))
def test_prompt_round_trip(spark, texts):
    marker = re.compile(r"(?m)^[ \t]*<<<\s*\d+\s*>>>[ \t]*$")
    if any(marker.search(t) for t in texts) or any(not t.strip() for t in texts):
        return
    parsed = prompts.parse_response(prompts.user_prompt(F.col("t")), F.size("t"))
    assert one(spark, parsed, t=texts) == [t.strip() for t in texts]
