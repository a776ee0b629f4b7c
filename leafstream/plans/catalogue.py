"""The engine's queries over the run's tables, and the SQL that checks them."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstream.functions import progress, prompts
from leafstream.functions import providers as P
from leafstream.functions import text as T
from leafstream.operators import cache, chunking, layouts, segmentation, telemetry
from leafstream.operators import providers as pools
from leafstream.operators.dispatch import Key, Provider, Settings, dispatch
from leafstream.operators.services import Echo
from leafstream.plans import run_tables as R
from leafstream.sources import books, word
from leafstream.sources import files as sources
from leafstream.sources.shared import new_path, settle, shared_folder
from leafstream.sources.tables import table
from leafstream.streaming import progress as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---- shared parts of the SQL -------------------------------------------------------------------------------

_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WITH = rf"""
    chunk AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY attempts DESC NULLS LAST, queued_at DESC NULLS LAST) AS rn
        FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1
    ),
    segment AS (
        SELECT chunk_id, job_id, file_hash, chunk_no, CAST(generate_subscripts(texts, 1) - 1 AS INTEGER) AS text_no,
               unnest(seg_ids) AS seg_id, unnest(texts) AS txt
        FROM chunk
    ),
    part AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY logged_at DESC NULLS LAST) AS rn
        FROM recent_parts WHERE part_id IS NOT NULL) WHERE rn = 1
    ),
    attempt AS (
        SELECT * EXCLUDE (rn, provider), lower(trim(provider)) AS provider FROM (
            SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY logged_at DESC NULLS LAST) AS rn
            FROM attempts WHERE attempt_id IS NOT NULL) WHERE rn = 1
    ),
    setting AS (
        SELECT j.job_id, coalesce(s.max_chars, 2500) AS max_chars, coalesce(s.persian_digits, false) AS persian_digits,
               coalesce(s.run_mode, 'translate') AS mode, j.status, j.filename
        FROM jobs j LEFT JOIN dispatch_settings s USING (settings_id)
    ),
    answered AS (
        SELECT p.part_id, p.provider, c.job_id, p.file_hash, p.finished_at, unnest(c.seg_ids) AS seg_id, unnest(c.texts) AS txt,
               unnest(CASE WHEN len(c.texts) = 1 THEN [p.translation] ELSE string_split(p.translation, chr(10) || chr(10)) END) AS translation
        FROM part p JOIN chunk c USING (chunk_id)
        WHERE p.translation IS NOT NULL AND (len(c.texts) = 1 OR len(string_split(p.translation, chr(10) || chr(10))) = len(c.texts))
    ),
    saved AS (
        SELECT a.file_hash, s.mode, sha1(a.txt) AS seg_sha1, a.translation, a.finished_at AS written_at
        FROM answered a JOIN setting s ON s.job_id = a.job_id WHERE a.txt IS NOT NULL
    ),
    kept AS (
        SELECT file_hash, mode, seg_sha1, arg_max(translation, (written_at, translation)) AS translation
        FROM saved WHERE file_hash IS NOT NULL AND translation IS NOT NULL AND written_at IS NOT NULL GROUP BY ALL
    )
"""


def _query(name: str, sql: str | None = None, recursive: bool = False):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{_WITH}{sql}"
        return f

    return add


# ---- text --------------------------------------------------------------------------------------------------


@_query("translatable_segments", r"SELECT chunk_id, text_no, coalesce(regexp_matches(txt, '[\p{L}\p{Nl}\p{No}]'), false) AS translatable FROM segment")
def _(s, d):
    return R.segments(s, d).select("chunk_id", "text_no", T.is_translatable(F.col("text")).alias("translatable"))


@_query(
    "normalized_answers",
    """SELECT part_id, CASE WHEN s.persian_digits
            THEN translate(translate(translation, 'يكى', 'یکی'), '0123456789٠١٢٣٤٥٦٧٨٩', '۰۱۲۳۴۵۶۷۸۹۰۱۲۳۴۵۶۷۸۹')
            ELSE translate(translation, 'يكى', 'یکی') END AS normalized
       FROM part p LEFT JOIN setting s ON s.job_id = p.job_id""",
)
def _(s, d):
    rows = R.parts(s, d, "job_id", "translation").select("part_id", "job_id", "translation").join(R.job_settings(s, d).select("job_id", "persian_digits"), "job_id", "left")
    return rows.select("part_id", T.normalize_persian(F.col("translation"), F.coalesce("persian_digits", F.lit(False))).alias("normalized"))


@_query("segment_hashes", "SELECT chunk_id, text_no, CAST(length(txt) AS INTEGER) AS n_chars, sha1(txt) AS seg_sha1 FROM segment")
def _(s, d):
    return R.segments(s, d).select("chunk_id", "text_no", F.length("text").alias("n_chars"), T.segment_hash(F.col("text")).alias("seg_sha1"))


@_query(
    "stripped_segments",
    rf"SELECT chunk_id, text_no, regexp_replace(regexp_replace(txt, '^[{_SPACE}]+', ''), '[{_SPACE}]+\z', '') AS body FROM segment",
)
def _(s, d):
    return R.segments(s, d).select("chunk_id", "text_no", T.strip(F.col("text")).alias("body"))


@_query(
    "output_names",
    r"""SELECT job_id, CASE WHEN mode IN ('refine', 'review')
            THEN regexp_replace(regexp_replace(filename, '\.[^.]*$', ''), '\.fa$', '') || '.refined.fa' || ext
            ELSE regexp_replace(filename, '\.[^.]*$', '') || '.fa' || ext END AS output
        FROM (SELECT *, CASE lower(regexp_extract(filename, '(\.[^.]*)$', 1)) WHEN '.md' THEN '.txt' WHEN '.pdf' THEN '.docx'
            ELSE lower(regexp_extract(filename, '(\.[^.]*)$', 1)) END AS ext FROM setting)""",
)
def _(s, d):
    rows = R.job_settings(s, d)
    ext = T.extension(F.col("filename"))
    out = F.when(ext == ".md", ".txt").when(ext == ".pdf", ".docx").otherwise(ext)
    return rows.select("job_id", T.output_name(F.col("filename"), F.col("mode"), out).alias("output"))


@_query(
    "job_durations",
    """SELECT job_id, CASE WHEN t >= 3600 THEN (t // 3600) || 'h ' || (t % 3600 // 60) || 'm'
            WHEN t >= 60 THEN (t // 60) || 'm ' || (t % 60) || 's' ELSE t || 's' END AS took
       FROM (SELECT job_id, greatest(0, CAST(floor((epoch_us(finished_at) - epoch_us(created_at)) / 1e6) AS BIGINT)) AS t FROM jobs WHERE finished_at IS NOT NULL)""",
)
def _(s, d):
    rows = table(s, d, "jobs").where("finished_at IS NOT NULL")
    seconds = F.floor((F.unix_micros("finished_at") - F.unix_micros("created_at")) / 1e6)
    return rows.select("job_id", T.duration(seconds).alias("took"))


# ---- segments and chunks -----------------------------------------------------------------------------------


@_query(
    "long_paragraphs",
    r""", unit AS (
            SELECT doc_id, text, CASE WHEN contains(text, chr(10)) THEN string_split(text, chr(10))
                ELSE string_split(regexp_replace(text, '([.!?…。！？])[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '\1' || chr(1), 'g'), chr(1)) END AS units
            FROM documents WHERE text IS NOT NULL AND length(text) > 4000
        ),
        walk AS (
            SELECT doc_id, units, 1 AS i, 0 AS piece_no, CAST(length(units[1]) AS BIGINT) AS size FROM unit
            UNION ALL
            SELECT doc_id, units, i + 1,
                CASE WHEN size > 0 AND size + length(units[i + 1]) + 1 > 4000 THEN piece_no + 1 ELSE piece_no END,
                CASE WHEN size = 0 OR size + length(units[i + 1]) + 1 > 4000 THEN length(units[i + 1]) ELSE size + length(units[i + 1]) + 1 END
            FROM walk WHERE i < len(units)
        )
        SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY piece_no) - 1 AS INTEGER) AS piece_no, CAST(length(p) AS INTEGER) AS n_chars, md5(p) AS digest
        FROM (SELECT w.doc_id, piece_no, CASE WHEN bool_or(contains(u.text, chr(10))) THEN string_agg(w.units[i], chr(10) ORDER BY i) ELSE string_agg(w.units[i], ' ' ORDER BY i) END AS p
              FROM walk w JOIN unit u USING (doc_id) WHERE size > 0 GROUP BY ALL)
        UNION ALL
        SELECT doc_id, 0, CAST(length(text) AS INTEGER), md5(text) FROM documents WHERE text IS NOT NULL AND length(text) <= 4000""",
    recursive=True,
)
def _(s, d):
    pieces = segmentation.split_long(F.col("text"), segmentation.PARAGRAPH)
    rows = table(s, d, "documents").select("doc_id", F.posexplode(pieces).alias("piece_no", "p"))
    return rows.select("doc_id", "piece_no", F.length("p").alias("n_chars"), F.md5("p").alias("digest"))


def _plan(s, d):
    rows = R.segments(s, d).join(R.job_settings(s, d).select("job_id", "max_chars"), "job_id", "left")
    rows = rows.select("job_id", "seg_id", "text", F.coalesce("max_chars", F.lit(2500)).alias("max_chars"))
    return chunking.make_chunks(rows, "job_id", "seg_id", "text", "max_chars")


_PLAN_SQL = """, ordered AS (
            SELECT g.job_id, g.seg_id, coalesce(length(g.txt), 0) AS n_chars, coalesce(s.max_chars, 2500) AS most,
                   row_number() OVER (PARTITION BY g.job_id ORDER BY g.seg_id) AS i
            FROM segment g LEFT JOIN setting s ON s.job_id = g.job_id WHERE g.job_id IS NOT NULL
        ),
        walk AS (
            SELECT job_id, seg_id, n_chars, i, 0 AS chunk_no, CAST(n_chars + 12 AS BIGINT) AS size FROM ordered WHERE i = 1
            UNION ALL
            SELECT o.job_id, o.seg_id, o.n_chars, o.i,
                   CASE WHEN w.size + o.n_chars + 12 > o.most THEN w.chunk_no + 1 ELSE w.chunk_no END,
                   CASE WHEN w.size + o.n_chars + 12 > o.most THEN o.n_chars + 12 ELSE w.size + o.n_chars + 12 END
            FROM walk w JOIN ordered o ON o.job_id = w.job_id AND o.i = w.i + 1
        )"""


@_query("chunk_plan", _PLAN_SQL + " SELECT job_id, seg_id, CAST(n_chars AS INTEGER) AS n_chars, CAST(chunk_no AS INTEGER) AS chunk_no FROM walk", recursive=True)
def _(s, d):
    limits = R.job_settings(s, d).select("job_id", "max_chars")
    rows = R.lengths(s, d).join(limits, "job_id", "left").withColumn("max_chars", F.coalesce("max_chars", F.lit(2500)))
    return chunking.plan_chunks(rows, "job_id", "seg_id", "n_chars", "max_chars")


@_query(
    "chunk_sizes",
    _PLAN_SQL + """ SELECT job_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(count(*) AS INTEGER) AS n_segments,
        CAST(sum(n_chars) AS INTEGER) AS chars FROM walk GROUP BY ALL""",
    recursive=True,
)
def _(s, d):
    made = chunking.assemble(_plan(s, d), "job_id")
    return made.select("job_id", "chunk_no", F.size("seg_ids").alias("n_segments"), "chars")


@_query(
    "halved_chunks",
    """SELECT chunk_id, CAST(h AS INTEGER) AS part, array_to_string(list_transform(CASE WHEN h = 0 THEN seg_ids[1:len(seg_ids) // 2] WHEN h = 1 THEN seg_ids[len(seg_ids) // 2 + 1:] ELSE seg_ids END, lambda x: CAST(x AS VARCHAR)), ',') AS seg_ids
       FROM (SELECT chunk_id, seg_ids, unnest(CASE WHEN len(seg_ids) > 1 THEN [0, 1] ELSE [NULL] END) AS h FROM chunk)""",
)
def _(s, d):
    rows = R.chunks(s, d, "chunk_no", "seg_ids", "texts")
    return chunking.halve(rows, "chunk_id").select("chunk_id", "part", F.array_join(F.col("seg_ids").cast("array<string>"), ",").alias("seg_ids"))


_LINED = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _large(sql: str) -> str:
    return f"translate({sql}, '{_SMALL}', '{_LARGE}')"


@_query("text_round_trip", f"SELECT doc_id, md5({_LINED}) AS digest FROM documents WHERE text IS NOT NULL")
def _(s, d):
    none = s.createDataFrame([], "doc_id bigint, seg_id int, translation string")
    return layouts.build_text(segmentation.text_layouts(table(s, d, "documents")), none).select("doc_id", F.md5("text").alias("digest"))


@_query("text_rebuilt", f"SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN {_LINED} ELSE {_large(_LINED)} END) AS digest FROM documents WHERE text IS NOT NULL")
def _(s, d):
    # each text's pieces in capitals, put back where they stood; a third of the texts has no results
    whole = settle(segmentation.text_layouts(table(s, d, "documents")), "layouts")
    results = segmentation.segments_of(whole).where("doc_id % 3 <> 0").select("doc_id", "seg_id", F.translate("text", _SMALL, _LARGE).alias("translation"))
    return layouts.build_text(whole, results).select("doc_id", F.md5("text").alias("digest"))


@_query(
    "text_paragraphs",
    rf""", paragraph AS (
            SELECT doc_id, unnest(string_split(regexp_replace({_LINED}, '\n[{_SPACE}]*\n', chr(1), 'g'), chr(1))) AS p FROM documents WHERE text IS NOT NULL
        )
        SELECT doc_id, count(*) AS n_paragraphs, CAST(sum(length(regexp_replace(regexp_replace(p, '^[{_SPACE}]+', ''), '[{_SPACE}]+\z', ''))) AS BIGINT) AS chars
        FROM paragraph WHERE regexp_matches(p, '[\p{{L}}\p{{Nl}}\p{{No}}]') GROUP BY doc_id""",
)
def _(s, d):
    found = F.filter(segmentation.paragraphs(segmentation.newlines(F.col("text"))), lambda p: p["seg"])
    rows = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", found.alias("p")).where(F.size("p") > 0)
    chars = F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + F.length(T.strip(p["raw"])))
    return rows.select("doc_id", F.size("p").cast("long").alias("n_paragraphs"), chars.alias("chars"))


def _subtitles(s, d):
    """Subtitles made of the chunks' texts, a cue for each: real texts in the form that the parser reads."""
    block = lambda t, i: F.concat(
        (i + 1).cast("string"), F.lit("\n00:00:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(",000 --> 00:00:59,500\n"), F.regexp_replace(F.coalesce(t, F.lit("")), r"\s*\n\s*", "\n")
    )
    return R.chunks(s, d, "texts").select(F.col("chunk_id").alias("doc_id"), F.array_join(F.transform("texts", block), "\n\n").alias("text"))


_CUES_SQL = rf""", subtitle AS (
        SELECT chunk_id AS doc_id, array_to_string(list_transform(texts, lambda t, i: i || chr(10) || '00:00:' || lpad(CAST((i - 1) % 60 AS VARCHAR), 2, '0') || ',000 --> 00:00:59,500'
            || chr(10) || regexp_replace(coalesce(t, ''), '[\x09-\x0d ]*\n[\x09-\x0d ]*', chr(10), 'g')), chr(10) || chr(10)) AS text FROM chunk
    ),
    block AS (
        SELECT doc_id, unnest(b) AS b, generate_subscripts(b, 1) - 1 AS cue_no FROM (SELECT doc_id,
            string_split(regexp_replace(regexp_replace(regexp_replace({_LINED}, '^\n+', ''), '\n+\z', ''), '\n[{_SPACE}]*\n', chr(1), 'g'), chr(1)) AS b FROM subtitle)
    ),
    lined AS (
        SELECT doc_id, cue_no, string_split(b, chr(10)) AS lines, list_min(list_transform(string_split(b, chr(10)), lambda l, i:
            CASE WHEN regexp_matches(l, '\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}:\p{{Nd}}{{2}}[,.]\p{{Nd}}{{1,3}}[ \t]*-->[ \t]*\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}:\p{{Nd}}{{2}}[,.]\p{{Nd}}{{1,3}}') THEN i END)) AS head FROM block
    ),
    cue AS (
        SELECT doc_id, cue_no, coalesce(head, len(lines)) AS header_lines, array_to_string(lines[:coalesce(head, len(lines))], chr(10)) AS header,
               CASE WHEN head IS NOT NULL THEN replace(array_to_string(lines[head + 1:], chr(10)), chr(8207), '') END AS body FROM lined
    )"""
_WORTH_SQL = r"coalesce(regexp_matches(body, '[\p{L}\p{Nl}\p{No}]'), false)"


@_query(
    "subtitle_cues",
    _CUES_SQL + f""" SELECT doc_id, CAST(cue_no AS INTEGER) AS cue_no, CAST(header_lines AS INTEGER) AS header_lines, CAST(length(body) AS INTEGER) AS n_chars,
        md5(body) AS digest, {_WORTH_SQL} AS translatable FROM cue""",
)
def _(s, d):
    cues = segmentation.subtitle_cues(_subtitles(s, d))
    return cues.select("doc_id", "cue_no", F.size("header").alias("header_lines"), F.length("body").alias("n_chars"), F.md5("body").alias("digest"), "translatable")


@_query(
    "subtitles_rebuilt",
    _CUES_SQL + f""", made AS (SELECT doc_id, cue_no, header, CASE WHEN {_WORTH_SQL} THEN array_to_string(list_transform(string_split({_large("body")}, chr(10)),
            lambda x: CASE WHEN x = '' THEN x ELSE chr(8207) || x END), chr(10)) ELSE body END AS body FROM cue)
        SELECT doc_id, md5(string_agg(CASE WHEN coalesce(body, '') = '' THEN header ELSE header || chr(10) || body END, chr(10) || chr(10) ORDER BY cue_no) || chr(10)) AS digest
        FROM made GROUP BY doc_id""",
)
def _(s, d):
    whole = settle(segmentation.subtitle_layouts(_subtitles(s, d)), "layouts")
    results = segmentation.segments_of(whole).select("doc_id", "seg_id", F.translate("text", _SMALL, _LARGE).alias("translation"))
    return layouts.build_subtitles(whole, results).select("doc_id", F.md5("text").alias("digest"))


def _pages(s, d):
    """The documents in pages of forty lines, each under its running header."""
    lines = F.split("text", "\n", -1)
    page = lambda i: F.concat(F.lit("The run's notebooks "), i.cast("string"), F.lit("\n\n"), F.array_join(F.slice(lines, i * 40 + 1, F.lit(40)), "\n"))
    many = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 40).cast("int"))
    rows = table(s, d, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", F.posexplode(F.transform(many, page)).alias("page_no", "text"))


_PAGES_SQL = rf""", page AS (
        SELECT doc_id, page_no, list_transform(string_split(replace('The run''s notebooks ' || page_no || chr(10) || chr(10) || array_to_string(l[page_no * 40 + 1:page_no * 40 + 40], chr(10)), chr(13), chr(10)), chr(10)),
            lambda x: regexp_replace(regexp_replace(regexp_replace(x, '[ \t\x{{a0}}]+', ' ', 'g'), '^[{_SPACE}]+', ''), '[{_SPACE}]+\z', '')) AS lines
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(0, (len(string_split(text, chr(10))) - 1) // 40 + 1)) AS page_no FROM documents WHERE text IS NOT NULL)
    ),
    usual AS (
        SELECT *, coalesce(n[CAST(floor(len(n) * 0.8) AS INTEGER) + 1], 0) AS usual
        FROM (SELECT *, list_sort(list_transform(list_filter(lines, lambda x: x <> ''), lambda x: length(x))) AS n FROM page)
    ),
    line AS (
        SELECT doc_id, page_no, usual, i, lines[i] AS line, coalesce(list_filter(lines[i + 1:], lambda x: x <> '')[1], '') AS following
        FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM usual)
    ),
    step AS (
        SELECT *, length(line) < usual * 0.75 AND (regexp_matches(line, '[.!?…:;"''»”)\]][{_SPACE}]*\z')
            OR regexp_matches(following, '^\p{{Lu}}') AND length(line) < usual * 0.5) AS ends, regexp_matches(line, '^\p{{Ll}}') AS small FROM line
    ),
    glue AS (
        SELECT doc_id, page_no, CAST(0 AS BIGINT) AS i, '' AS cur, CAST([] AS VARCHAR[]) AS paras FROM usual
        UNION ALL
        SELECT g.doc_id, g.page_no, s.i, CASE WHEN s.line = '' OR s.ends THEN '' ELSE longer END,
            CASE WHEN s.line = '' AND g.cur <> '' THEN list_append(g.paras, g.cur) WHEN s.line <> '' AND s.ends THEN list_append(g.paras, longer) ELSE g.paras END
        FROM (SELECT glue.doc_id, glue.page_no, glue.paras, glue.cur, CASE WHEN glue.cur = '' THEN step.line
                WHEN regexp_matches(glue.cur, '(?s)(^|[^ ])-\z') AND step.small THEN left(glue.cur, length(glue.cur) - 1) || step.line ELSE glue.cur || ' ' || step.line END AS longer, step.i
              FROM glue JOIN step ON step.doc_id = glue.doc_id AND step.page_no = glue.page_no AND step.i = glue.i + 1) g
        JOIN step s ON s.doc_id = g.doc_id AND s.page_no = g.page_no AND s.i = g.i
    ),
    glued AS (
        SELECT g.doc_id, g.page_no, CASE WHEN g.cur = '' THEN g.paras ELSE list_append(g.paras, g.cur) END AS paras
        FROM glue g JOIN usual u ON u.doc_id = g.doc_id AND u.page_no = g.page_no AND g.i = len(u.lines)
    )"""


@_query("page_paragraphs", _PAGES_SQL + " SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, CAST(len(paras) AS INTEGER) AS n, md5(array_to_string(paras, chr(10))) AS digest FROM glued", recursive=True)
def _(s, d):
    pages = _pages(s, d).select("doc_id", "page_no", segmentation.page_paragraphs(F.col("text")).alias("paragraphs"))
    return pages.select("doc_id", "page_no", F.size("paragraphs").alias("n"), F.md5(F.array_join("paragraphs", "\n")).alias("digest"))


_HEADERS_SQL = _PAGES_SQL + r""", edge AS (
        SELECT doc_id, regexp_replace(e, '\p{Nd}+', '#', 'g') AS shape, count(*) AS n
        FROM (SELECT doc_id, unnest(list_distinct([paras[1], paras[-1]])) AS e FROM glued WHERE len(paras) > 0) WHERE length(e) < 80 GROUP BY ALL
    ),
    common AS (
        SELECT e.doc_id, list(e.shape) AS shapes FROM edge e JOIN (SELECT doc_id, count(*) AS n_pages FROM glued GROUP BY doc_id HAVING count(*) >= 4) c USING (doc_id)
        WHERE e.n >= c.n_pages * 0.5 GROUP BY e.doc_id
    ),
    headless AS (
        SELECT g.doc_id, g.page_no, coalesce(c.shapes, []) AS shapes, CASE WHEN list_contains(c.shapes, regexp_replace(g.paras[1], '\p{Nd}+', '#', 'g')) THEN g.paras[2:] ELSE g.paras END AS paras
        FROM glued g LEFT JOIN common c USING (doc_id)
    ),
    kept AS (
        SELECT doc_id, page_no, CASE WHEN list_contains(shapes, regexp_replace(paras[-1], '\p{Nd}+', '#', 'g')) THEN paras[:-2] ELSE paras END AS paras FROM headless
    )"""


@_query("running_headers", _HEADERS_SQL.replace("kept AS", "body AS") + " SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, CAST(len(paras) AS INTEGER) AS n, md5(array_to_string(paras, chr(10))) AS digest FROM body", recursive=True)
def _(s, d):
    pages = _pages(s, d).select("doc_id", "page_no", segmentation.page_paragraphs(F.col("text")).alias("paragraphs"))
    kept = segmentation.drop_running_headers(pages)
    return kept.select("doc_id", "page_no", F.size("paragraphs").alias("n"), F.md5(F.array_join("paragraphs", "\n")).alias("digest"))


# ---- prompts and answers -----------------------------------------------------------------------------------

_PROMPT_SQL = """CASE WHEN len(texts) = 1 THEN coalesce(texts[1], '') ELSE array_to_string(list_transform(texts,
    lambda t, i: '<<<' || i || '>>>' || chr(10) || coalesce(t, '')), chr(10)) END"""


@_query("user_prompts", f"SELECT chunk_id, md5({_PROMPT_SQL}) AS digest FROM chunk")
def _(s, d):
    return R.chunks(s, d, "texts").select("chunk_id", F.md5(prompts.user_prompt(F.col("texts"))).alias("digest"))


def _answers(s, d):
    """Answers made of the prompts: every seventh chunk of a kind is right, renumbered, cut, prefaced and so on."""
    p = prompts.user_prompt(F.col("texts"))
    kind = F.col("chunk_id") % 7
    answer = (
        F.when(kind == 1, F.concat(F.lit("Here it is:\n"), p))
        .when(kind == 2, F.replace(p, F.lit("<<<2>>>"), F.lit("<<<3>>>")))
        .when(kind == 3, F.replace(p, F.lit("\n"), F.lit("\r\n")))
        .when(kind == 4, F.concat(p, F.lit("\n<<<99>>>\n")))
        .when(kind == 5, F.translate(p, "123456789", "۱۲۳۴۵۶۷۸۹"))
        .otherwise(p)
    )
    return R.chunks(s, d, "texts").select("chunk_id", F.size("texts").alias("n"), answer.alias("answer"))


@_query(
    "parsed_answers",
    rf""", made AS (SELECT chunk_id, len(texts) AS n, {_PROMPT_SQL} AS p FROM chunk),
        answer AS (SELECT chunk_id, n, CASE chunk_id % 7 WHEN 1 THEN 'Here it is:' || chr(10) || p WHEN 2 THEN replace(p, '<<<2>>>', '<<<3>>>')
            WHEN 3 THEN replace(p, chr(10), chr(13) || chr(10)) WHEN 4 THEN p || chr(10) || '<<<99>>>' || chr(10)
            WHEN 5 THEN translate(p, '123456789', '۱۲۳۴۵۶۷۸۹') ELSE p END AS a FROM made),
        cut AS (SELECT chunk_id, n, a, regexp_extract_all(a, '(?m)^[ \t]*<<<[{_SPACE}]*(\p{{Nd}}+)[{_SPACE}]*>>>[ \t]*$', 1) AS numbers,
            string_split(regexp_replace(a, '(?m)^[ \t]*<<<[{_SPACE}]*\p{{Nd}}+[{_SPACE}]*>>>[ \t]*$', chr(1), 'g'), chr(1)) AS bodies FROM answer),
        trimmed AS (SELECT chunk_id, n, list_transform(numbers, lambda x: try_cast(translate(x, '۰۱۲۳۴۵۶۷۸۹', '0123456789') AS BIGINT)) AS numbers,
            list_transform(bodies, lambda b: regexp_replace(regexp_replace(b, '^[{_SPACE}]+', ''), '[{_SPACE}]+\z', '')) AS bodies,
            regexp_replace(regexp_replace(array_to_string(bodies, ''), '^[{_SPACE}]+', ''), '[{_SPACE}]+\z', '') AS whole FROM cut)
        SELECT chunk_id, CASE WHEN n = 1 THEN md5(whole)
            WHEN numbers = list_transform(range(1, n + 1), lambda x: CAST(x AS BIGINT)) AND len(list_filter(bodies[2:], lambda b: b = '')) = 0
            THEN md5(array_to_string(bodies[2:], chr(1))) END AS digest
        FROM trimmed""",
)
def _(s, d):
    parsed = prompts.parse_response(F.col("answer"), F.col("n"))
    return _answers(s, d).select("chunk_id", F.md5(F.array_join(parsed, "\u0001")).alias("digest"))


def _clean_sql(table_: str, key: str, text: str) -> str:
    """CTEs that end in `clean`: what is left of each text without reasoning and a fence around the whole."""
    return rf""", spoken AS (SELECT {key}, regexp_replace({text}, '(?is)<think>.*?</think>|<thinking>.*?</thinking>|<reasoning>.*?</reasoning>', '', 'g') AS x FROM {table_}),
        bare AS (SELECT {key}, regexp_replace(regexp_replace(CASE WHEN contains(x, '</think>') THEN substr(x, strpos(x, '</think>') + 8) ELSE x END, '^[{_SPACE}]+', ''), '[{_SPACE}]+\z', '') AS x FROM spoken),
        inside AS (SELECT {key}, x, starts_with(x, '```') AND ends_with(x, '```') AS fenced, substr(x, 4, greatest(length(x) - 6, 0)) AS y FROM bare),
        clean AS (SELECT {key}, regexp_replace(regexp_replace(CASE WHEN NOT fenced THEN x WHEN contains(y, chr(10)) THEN substr(y, strpos(y, chr(10)) + 1) ELSE y END, '^\n+', ''), '\n+\z', '') AS x FROM inside)"""


_TRIMMED = rf"regexp_replace(regexp_replace(coalesce(translation, ''), '^[{_SPACE}]+', ''), '[{_SPACE}]+\z', '')"


@_query(
    "cleaned_outputs",
    rf""", wrapped AS (SELECT part_id, CASE part_id % 4 WHEN 0 THEN '<think>a' || chr(10) || 'b</think>' || coalesce(translation, '') WHEN 1 THEN 'so it is</think>' || coalesce(translation, '')
            WHEN 2 THEN '```text' || chr(10) || {_TRIMMED} || chr(10) || '```' ELSE coalesce(translation, '') END AS w FROM part)"""
    + _clean_sql("wrapped", "part_id", "w")
    + " SELECT part_id, md5(x) AS digest FROM clean",
)
def _(s, d):
    kind = F.col("part_id") % 4
    t = F.coalesce("translation", F.lit(""))
    wrapped = (
        F.when(kind == 0, F.concat(F.lit("<think>a\nb</think>"), t))
        .when(kind == 1, F.concat(F.lit("so it is</think>"), t))
        .when(kind == 2, F.concat(F.lit("```text\n"), T.strip(t), F.lit("\n```")))
        .otherwise(t)
    )
    return R.parts(s, d, "translation").select("part_id", F.md5(prompts.clean_output(wrapped)).alias("digest"))


@_query(
    "service_answers",
    _clean_sql("part", "part_id", "coalesce(translation, '')")
    + rf""" SELECT part_id, CASE WHEN part_id % 5 = 1 THEN 'rate_limit' WHEN part_id % 5 = 2 OR blank THEN 'transient' WHEN part_id % 5 = 3 THEN 'too_large' END AS kind,
            CASE WHEN part_id % 5 IN (0, 4) AND NOT blank THEN md5(x) END AS digest
        FROM (SELECT part_id, x, NOT regexp_matches(x, '[^{_SPACE}]') AS blank FROM clean)""",
)
def _(s, d):
    kind = F.col("part_id") % 5
    good = lambda finish: F.to_json(
        F.struct(F.array(F.struct(F.struct(F.coalesce("translation", F.lit("")).alias("content")).alias("message"), F.lit(finish).alias("finish_reason"))).alias("choices"))
    )
    raw = (
        F.when(kind == 1, '{"error": {"message": "too many requests"}}').when(kind == 2, "<html>").when(kind == 3, good("length")).otherwise(good("stop"))
    )
    told = R.parts(s, d, "translation").select("part_id", P.answer(raw).alias("a"))
    return told.select("part_id", "a.kind", F.md5("a.text").alias("digest"))


#: Messages of services, and their kinds.
_SAID = (("You exceeded your current quota", "quota"), ("quota: try again in 7s", "rate_limit"), ("Rate limit reached", "rate_limit"), ("invalid api key given", "auth"), ("Unauthorized", "auth"), ("tokens per day used up", "quota"), ("upstream hiccup", "transient"))


@_query("message_kinds", f", n AS (SELECT attempt_id, attempt_id % {len(_SAID)} AS k FROM attempt) SELECT attempt_id, CASE k " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(_SAID)) + " END AS kind FROM n")
def _(s, d):
    said = F.get(F.array(*[F.lit(m) for m, _ in _SAID]), (F.col("attempt_id") % len(_SAID)).cast("int"))
    return R.attempts(s, d).select("attempt_id", P.message_kind(said).alias("kind"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@_query(
    "system_prompts",
    f"""SELECT settings_id, md5(base || CASE WHEN extra = '' THEN '' ELSE {_quoted(prompts.EXTRA)} || extra END) AS digest
        FROM (SELECT settings_id, CASE WHEN coalesce(run_mode, 'translate') IN ('refine', 'review') THEN {_quoted(prompts.BASE["refine"])} ELSE {_quoted(prompts.BASE["translate"])} END AS base,
            regexp_replace(regexp_replace(coalesce(extra_instructions, ''), '^[{_SPACE}]+', ''), '[{_SPACE}]+\\z', '') AS extra FROM dispatch_settings)""",
)
def _(s, d):
    prompt = prompts.system_prompt(prompts.base_prompt(F.coalesce("run_mode", F.lit("translate"))), F.col("extra_instructions"))
    return table(s, d, "dispatch_settings").select("settings_id", F.md5(prompt).alias("digest"))


@_query(
    "error_kinds",
    """, told AS (SELECT attempt_id, status_code, CASE attempt_id % 4 WHEN 0 THEN 'quota exceeded for today' WHEN 1 THEN 'limit per minute, daily quota'
            WHEN 2 THEN 'maximum context length' ELSE '' END AS body FROM attempt)
       SELECT attempt_id, CASE WHEN status_code IS NULL THEN NULL WHEN status_code = 402 THEN 'quota'
            WHEN status_code = 429 THEN CASE WHEN attempt_id % 4 = 0 THEN 'quota' ELSE 'rate_limit' END
            WHEN status_code IN (401, 403) THEN CASE WHEN attempt_id % 4 = 0 THEN 'quota' ELSE 'auth' END
            WHEN status_code IN (408, 409, 425) OR status_code >= 500 THEN 'transient' WHEN status_code = 413 THEN 'too_large'
            WHEN status_code = 400 AND body LIKE '%context%' THEN 'too_large' WHEN attempt_id % 4 = 0 THEN 'quota' ELSE 'fatal' END AS kind
       FROM told""",
)
def _(s, d):
    n = F.col("attempt_id") % 4
    body = F.when(n == 0, "quota exceeded for today").when(n == 1, "limit per minute, daily quota").when(n == 2, "maximum context length").otherwise("")
    return R.attempts(s, d, "status_code").select("attempt_id", P.error_kind(F.col("status_code"), body).alias("kind"))


@_query(
    "pauses",
    """SELECT attempt_id, coalesce(retry_after, least(21600.0, 1800.0 * pow(2, attempt_no - 1))) AS quota,
            coalesce(retry_after, least(120.0, 10.0 * pow(2, least(attempt_no - 1, 4)))) AS rate,
            CASE WHEN attempt_no >= 5 THEN 120.0 ELSE least(60.0, 3.0 * pow(2, least(attempt_no - 1, 4))) END AS error FROM attempt""",
)
def _(s, d):
    n, wait = F.col("attempt_no"), F.col("retry_after")
    return R.attempts(s, d, "attempt_no", "retry_after").select("attempt_id", P.quota_pause(n, wait).alias("quota"), P.rate_pause(n, wait).alias("rate"), P.error_pause(n).alias("error"))


# ---- providers and settings --------------------------------------------------------------------------------

_URL = r"regexp_replace(trim(base_url), '/+$', '')"
_ROLES = """CASE WHEN len(list_filter(coalesce(use_for, []), lambda r: r IN ('translate', 'review'))) IN (0) THEN 'translate,review'
    ELSE array_to_string(list_filter(['translate', 'review'], lambda r: list_contains(use_for, r)), ',') END"""
_KEYS = r"list_filter(regexp_split_to_array(coalesce(api_key, ''), '[,;\s]+'), lambda k: k <> '')"


@_query(
    "provider_configs",
    rf"""SELECT name, CASE WHEN {_URL} LIKE '%/chat/completions' THEN {_URL} ELSE {_URL} || '/chat/completions' END AS chat_url,
            regexp_replace({_URL}, '/chat/completions$', '') || '/models' AS models_url, CAST(len({_KEYS}) AS INTEGER) AS n_keys,
            greatest(1, coalesce(concurrency, 1)) AS concurrency, coalesce(enabled, true) AS enabled, {_ROLES} AS roles
        FROM providers""",
)
def _(s, d):
    rows = pools.configured(table(s, d, "providers"))
    url = F.col("base_url")
    return rows.select("name", P.chat_url(url).alias("chat_url"), P.models_url(url).alias("models_url"), F.size("keys").alias("n_keys"), "concurrency", "enabled", F.array_join("roles", ",").alias("roles"))


@_query(
    "provider_keys",
    rf""", k AS (SELECT name, greatest(1, coalesce(concurrency, 1)) AS concurrency, unnest(CASE WHEN len({_KEYS}) = 0 THEN [NULL] ELSE {_KEYS} END) AS key,
            generate_subscripts(CASE WHEN len({_KEYS}) = 0 THEN [NULL] ELSE {_KEYS} END, 1) - 1 AS key_no FROM providers)
        SELECT name, CAST(key_no AS INTEGER) AS key_no, CASE WHEN coalesce(key, '') = '' THEN '(no key)' WHEN length(key) > 10 THEN left(key, 4) || '…' || right(key, 4) ELSE '…' END AS key_label FROM k""",
)
def _(s, d):
    return pools.endpoints(pools.configured(table(s, d, "providers"))).select("name", "key_no", "key_label")


@_query(
    "job_providers",
    f""", able AS (SELECT name, {_ROLES} AS roles FROM providers WHERE coalesce(enabled, true))
        SELECT s.job_id, array_to_string(list_sort(list(a.name)), ',') AS names FROM setting s
        JOIN able a ON contains(a.roles, CASE WHEN s.mode IN ('refine', 'review') THEN 'review' ELSE 'translate' END) GROUP BY s.job_id""",
)
def _(s, d):
    able = pools.configured(table(s, d, "providers")).where("enabled AND problem IS NULL").select("name", F.explode("roles").alias("role"))
    by_role = able.groupBy("role").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return R.job_settings(s, d).withColumn("role", P.mode_role(F.col("mode"))).join(by_role, "role").select("job_id", "names")


@_query(
    "clamped_settings",
    """SELECT settings_id, least(20000, greatest(300, coalesce(max_chars, 2500))) AS max_chars, least(30, greatest(1, coalesce(max_attempts, 6))) AS max_attempts,
            greatest(20.0, coalesce(timeout_s, 240.0)) AS timeout_s FROM dispatch_settings""",
)
def _(s, d):
    return pools.clamped(table(s, d, "dispatch_settings")).select("settings_id", "max_chars", "max_attempts", "timeout_s")


@_query("worker_totals", f"SELECT CAST(sum(greatest(1, coalesce(concurrency, 1))) AS BIGINT) AS workers, CAST(sum(len({_KEYS})) AS BIGINT) AS n_keys, array_to_string(list_sort(list_distinct(list(model))), ',') AS models FROM providers WHERE coalesce(enabled, true)")
def _(s, d):
    return pools.totals(pools.configured(table(s, d, "providers"))).select("workers", "n_keys", F.array_join("models", ",").alias("models"))


@_query(
    "skipped_providers",
    f""", p AS (SELECT name, {_ROLES} AS roles FROM providers WHERE coalesce(enabled, true))
        SELECT mode, name, name || ': for only ' || roles AS note FROM p JOIN (VALUES ('translate', 'translate'), ('refine', 'review')) m(mode, role) ON NOT contains(roles, role)""",
)
def _(s, d):
    rows = pools.configured(table(s, d, "providers"))
    return reduce(DataFrame.unionByName, [pools.skipped(rows, F.lit(m)).withColumn("mode", F.lit(m)) for m in ("translate", "refine")])


@_query(
    "provider_problems",
    f"""SELECT name, CASE WHEN no = 1 THEN 'no URL' WHEN no = 2 THEN 'no model' WHEN no IN (3, 4) THEN 'name is not unique' END AS problem
        FROM providers, (VALUES (0), (1), (2), (3), (4)) v(no)""".replace("SELECT name,", "SELECT CASE WHEN no IN (3, 4) THEN name || ' 3' ELSE name || ' ' || no END AS name,"),
)
def _(s, d):
    # each provider as it is, without URL, without model, and twice under one name
    own = table(s, d, "providers").withColumn("no", F.explode(F.array(*map(F.lit, range(5)))))
    named = own.withColumn("name", F.concat_ws(" ", "name", F.least("no", F.lit(3)).cast("string")))
    changed = named.withColumn("base_url", F.when(F.col("no") != 1, F.col("base_url"))).withColumn("model", F.when(F.col("no") != 2, F.col("model")))
    return pools.configured(changed.drop("no")).select("name", "problem")


@_query(
    "providers_file",
    f"""SELECT name, {_ROLES} AS roles, CAST(len({_KEYS}) AS INTEGER) AS n_keys, greatest(1, coalesce(concurrency, 1)) AS concurrency FROM providers WHERE coalesce(enabled, true)""",
)
def _(s, d):
    # written with other names of fields, and every second entry's roles as a text
    rows = table(s, d, "providers")
    common = [F.col(c) for c in ("name", "model", "concurrency", "enabled", "extra_headers")]
    even = F.length("name") % 2 == 0
    own = rows.where(even).select(*common, F.col("base_url").alias("url"), F.col("api_key").alias("key"), F.concat_ws(", ", "use_for").alias("roles"))
    rest = rows.where(~even).select(*common, "base_url", "api_key", "use_for")
    lines = own.select(F.to_json(F.struct("*")).alias("j")).unionByName(rest.select(F.to_json(F.struct("*")).alias("j")))
    whole = lines.agg(F.concat(F.lit('{"providers": ['), F.array_join(F.collect_list("j"), ", "), F.lit("]}")).alias("value"))
    path = new_path(s, "providers")
    whole.coalesce(1).write.text(path)
    found = pools.configured(sources.read_providers(s, path))
    return found.select("name", F.array_join("roles", ",").alias("roles"), F.size("keys").alias("n_keys"), "concurrency")


@_query("waiting_upsert", f"SELECT name, CAST(len({_KEYS}) + 1 AS INTEGER) AS n_keys, greatest(greatest(1, coalesce(concurrency, 1)), 3) AS concurrency FROM providers UNION ALL SELECT 'newcomer', 1, 3")
def _(s, d):
    rows, changes = _changes(s, d)
    return pools.upsert_waiting(rows, changes).select("name", F.size("keys").alias("n_keys"), "concurrency")


@_query(
    "revived_providers",
    f"""SELECT name, CASE WHEN name < 'm' THEN 'other' ELSE model END AS model, CAST(len({_KEYS}) + 1 AS INTEGER) AS n_keys, false AS disabled, true AS revived FROM providers
        UNION ALL SELECT 'newcomer', 'inv', 1, false, false""",
)
def _(s, d):
    # all are switched off: those of the alphabet's first half for their model, which changes, the others for their keys
    rows, changes = _changes(s, d)
    first = F.col("name") < "m"
    off = rows.withColumn("disabled", F.lit(True)).withColumn("disabled_reason", F.when(first, "no such model").otherwise("all keys were rejected"))
    changed = changes.withColumn("model", F.when(first & (F.col("name") != "newcomer"), "other").otherwise(F.col("model")))
    return pools.upsert(off, changed.withColumn("model", F.when(F.col("name") == "newcomer", "inv").otherwise(F.col("model")))).select("name", "model", F.size("keys").alias("n_keys"), "disabled", "revived")


def _changes(s, d):
    """(the providers as they run, changes to them): a key more and three requests at a time for each, and a newcomer."""
    rows = pools.configured(table(s, d, "providers")).withColumn("disabled", F.lit(False)).withColumn("disabled_reason", F.lit(""))
    none = F.lit(None).cast("string").alias("problem")
    more = rows.select("name", "base_url", F.array(F.lit("xk-more")).alias("keys"), "model", F.lit(3).alias("concurrency"), F.lit(True).alias("enabled"), none)
    new = s.range(1).select(F.lit("newcomer").alias("name"), F.lit("https://new.example/v1").alias("base_url"), F.array(F.lit("xk-new")).alias("keys"), F.lit("inv").alias("model"), F.lit(3).alias("concurrency"), F.lit(True).alias("enabled"), none)
    return rows, more.unionByName(new)


@_query(
    "provider_upsert",
    f"""SELECT name, CAST(len({_KEYS}) + 1 AS INTEGER) AS n_keys, greatest(greatest(1, coalesce(concurrency, 1)), 3) AS concurrency FROM providers
        UNION ALL SELECT 'newcomer', 1, 3""",
)
def _(s, d):
    return pools.upsert(*_changes(s, d)).select("name", F.size("keys").alias("n_keys"), "concurrency")


# ---- checkpoint and progress -------------------------------------------------------------------------------


def _keyed(s, d):
    rows = R.segments(s, d).where("text IS NOT NULL").join(R.job_settings(s, d).select("job_id", "mode"), "job_id")
    return rows.select("job_id", "seg_id", "file_hash", "mode", "text")


_KEYED = "SELECT g.job_id, g.seg_id, g.file_hash, s.mode, sha1(g.txt) AS seg_sha1, length(g.txt) AS n_chars FROM segment g JOIN setting s ON s.job_id = g.job_id WHERE g.txt IS NOT NULL"


@_query("checkpoint_written", "SELECT * FROM kept")
def _(s, d):
    # written twice, as by a run that was broken off and begun again
    entries = R.checkpoint(s, d).where("written_at IS NOT NULL")
    path = new_path(s, "checkpoint")
    for _ in range(2):
        cache.write(entries, path)
    return cache.latest(cache.read(s, path))


@_query("resume_plan", f", keyed AS ({_KEYED}) SELECT k.job_id, k.seg_id, k.seg_sha1, t.translation FROM keyed k LEFT JOIN kept t USING (file_hash, mode, seg_sha1)")
def _(s, d):
    return cache.lookup(_keyed(s, d), R.checkpoint(s, d)).select("job_id", "seg_id", "seg_sha1", "translation")


@_query("pending_segments", f", keyed AS ({_KEYED}) SELECT k.job_id, k.seg_id FROM keyed k ANTI JOIN kept t USING (file_hash, mode, seg_sha1)")
def _(s, d):
    return cache.pending(_keyed(s, d), R.checkpoint(s, d).where("written_at IS NOT NULL")).select("job_id", "seg_id")


@_query(
    "merged_results",
    f""", keyed AS ({_KEYED}), old AS (SELECT job_id, seg_id, t.translation FROM keyed k JOIN kept t USING (file_hash, mode, seg_sha1)),
        new AS (SELECT job_id, seg_id, max(translation) AS translation FROM answered WHERE provider IS NOT NULL GROUP BY ALL)
        SELECT job_id, seg_id, coalesce(new.translation, old.translation) AS translation FROM old FULL JOIN new USING (job_id, seg_id)""",
)
def _(s, d):
    old = cache.lookup(_keyed(s, d), R.checkpoint(s, d)).where("translation IS NOT NULL").select("job_id", "seg_id", "translation")
    new = R.answered(s, d).where("provider IS NOT NULL").groupBy("job_id", "seg_id").agg(F.max("translation").alias("translation"))
    return cache.merge(old, new, ["job_id", "seg_id"])


@_query(
    "job_progress",
    f""", keyed AS ({_KEYED}), marked AS (SELECT k.job_id, k.n_chars, t.translation IS NOT NULL AS hit FROM keyed k LEFT JOIN kept t USING (file_hash, mode, seg_sha1)),
        sums AS (SELECT job_id, count(*) AS total, count_if(hit) AS finished, sum(n_chars) AS total_chars, coalesce(sum(n_chars) FILTER (hit), 0) AS done_chars FROM marked GROUP BY job_id)
        SELECT j.job_id, coalesce(total, 0) AS total_segments, CAST(coalesce(finished, 0) AS BIGINT) AS done_segments, CAST(coalesce(total_chars, 0) AS BIGINT) AS total_chars,
            CAST(coalesce(done_chars, 0) AS BIGINT) AS done_chars,
            CASE WHEN j.status = 'done' THEN 100.0 ELSE least(100.0, coalesce(round_even(100 * done_chars / nullif(total_chars, 0), 1), 0.0)) END AS percent, j.status
        FROM jobs j LEFT JOIN sums USING (job_id)""",
)
def _(s, d):
    looked = cache.lookup(_keyed(s, d), R.checkpoint(s, d)).select("job_id", "seg_id", F.length("text").alias("n_chars"), "translation")
    return telemetry.job_progress(table(s, d, "jobs"), looked, looked.where("translation IS NOT NULL"))


_KEY_COLUMNS = ("key_label", "outcome", "retry_after", "attempted_at")
_POINT_COLUMNS = ("job_id", "outcome", "chars", "attempted_at")

# ---- telemetry ---------------------------------------------------------------------------------------------


@_query(
    "provider_stats",
    """SELECT provider, count(*) AS attempts, CAST(count_if(outcome = 'ok') AS BIGINT) AS done, CAST(count_if(outcome <> 'ok') AS BIGINT) AS failed,
            CAST(coalesce(sum(chars) FILTER (outcome = 'ok'), 0) AS BIGINT) AS chars,
            round_even(sum(seconds) FILTER (outcome = 'ok') / nullif(count_if(outcome = 'ok'), 0), 1) AS avg_seconds,
            count(DISTINCT key_label) AS keys_total, count(DISTINCT key_label) FILTER (outcome = 'auth') AS keys_dead FROM attempt GROUP BY provider""",
)
def _(s, d):
    return telemetry.provider_stats(R.attempts(s, d, "key_label", "outcome", "chars", "seconds"))


_KEYS_SQL = """, k AS (SELECT *, row_number() OVER w AS n FROM attempt WHERE key_label IS NOT NULL WINDOW w AS (PARTITION BY provider, key_label ORDER BY attempted_at, attempt_id)),
        marks AS (SELECT provider, key_label, count(*) AS uses, coalesce(max(n) FILTER (outcome = 'rate_limit'), 0) AS rate_n, max(attempted_at) FILTER (outcome = 'ok') AS ok_at,
            coalesce(max(n) FILTER (outcome = 'ok'), 0) AS ok_n, max(n) FILTER (outcome IN ('quota', 'rate_limit', 'auth')) AS last_n, count_if(outcome = 'auth') AS auth FROM k GROUP BY ALL),
        hit AS (SELECT m.provider, m.key_label, count_if(k.outcome = 'quota' AND k.n > m.rate_n) AS hits, count_if(k.outcome = 'rate_limit' AND k.n > m.ok_n) AS limits
            FROM marks m JOIN k USING (provider, key_label) GROUP BY ALL),
        key_stat AS (SELECT m.provider, m.key_label, m.uses, m.auth > 0 AS dead,
            CASE WHEN l.outcome IS NULL OR coalesce(m.ok_at > l.attempted_at, false) THEN '' ELSE l.outcome END AS kind, h.hits AS quota_hits,
            coalesce(CAST(greatest(0, floor(epoch_us(l.attempted_at) / 1e6 + CASE l.outcome
                WHEN 'quota' THEN coalesce(l.retry_after, least(21600.0, 1800.0 * pow(2, greatest(h.hits, 1) - 1)))
                WHEN 'rate_limit' THEN coalesce(l.retry_after, least(120.0, 10.0 * pow(2, least(greatest(h.limits, 1) - 1, 4)))) END
                - (SELECT epoch_us(max(attempted_at)) FROM k) / 1e6)) AS BIGINT), 0) AS retry_in
        FROM marks m JOIN hit h USING (provider, key_label) LEFT JOIN k l ON l.provider = m.provider AND l.key_label = m.key_label AND l.n = m.last_n)"""


@_query("key_stats", _KEYS_SQL + " SELECT * FROM key_stat")
def _(s, d):
    return telemetry.key_stats(R.attempts(s, d, *_KEY_COLUMNS))


@_query("earliest_retry", _KEYS_SQL + " SELECT retry_in, provider FROM key_stat WHERE NOT dead ORDER BY retry_in, provider LIMIT 1")
def _(s, d):
    return telemetry.earliest_retry(telemetry.key_stats(R.attempts(s, d, *_KEY_COLUMNS)))


@_query("log_tail", "SELECT attempt_id AS line_no, outcome AS line FROM attempt WHERE (SELECT count(*) FROM attempt) <= 1000 OR attempt_id > (SELECT max(attempt_id) FROM attempt) - 500")
def _(s, d):
    lines = R.attempts(s, d, "outcome").select(F.col("attempt_id").alias("line_no"), F.col("outcome").alias("line"))
    return telemetry.log_tail(lines, 1000, 500)


_HISTORY = """, point AS (
            SELECT job_id, attempt_id, epoch_us(attempted_at) AS ts, coalesce(chars, 0) AS chars,
                   sum(coalesce(chars, 0)) OVER w AS done_chars, row_number() OVER w AS point_no
            FROM attempt WHERE outcome = 'ok' AND job_id IS NOT NULL AND attempted_at IS NOT NULL
            WINDOW w AS (PARTITION BY job_id ORDER BY attempted_at, attempt_id ROWS UNBOUNDED PRECEDING)
        )"""


@_query("progress_history", _HISTORY + " SELECT job_id, attempt_id, CAST(done_chars AS BIGINT) AS done_chars, point_no FROM point")
def _(s, d):
    return telemetry.history(R.attempts(s, d, *_POINT_COLUMNS)).select("job_id", "attempt_id", "done_chars", "point_no")


@_query(
    "speed_series",
    _HISTORY + """, total AS (SELECT job_id, CAST(sum(chars) AS BIGINT) AS total_chars FROM chunk GROUP BY job_id),
        near AS (SELECT *, count(*) OVER w AS n, first_value(ts) OVER w AS ts1, first_value(done_chars) OVER w AS done1
            FROM point WINDOW w AS (PARTITION BY job_id ORDER BY ts RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW)),
        held AS (SELECT near.*, first_value(ts) OVER r AS ts0, first_value(done_chars) OVER r AS done0 FROM near
            WINDOW r AS (PARTITION BY job_id ORDER BY point_no ROWS BETWEEN 399 PRECEDING AND CURRENT ROW)),
        based AS (SELECT *, CASE WHEN n >= 3 THEN ts1 ELSE ts0 END AS a, CASE WHEN n >= 3 THEN done1 ELSE done0 END AS c FROM held),
        fast AS (SELECT *, CASE WHEN point_no >= 2 AND done_chars > 0 AND done_chars > c AND ts > a THEN (done_chars - c) / ((ts - a) / 1e6) END AS speed FROM based)
        SELECT job_id, attempt_id, point_no, CAST(floor(speed * 60) AS BIGINT) AS chars_per_min,
            CASE WHEN speed > 0 THEN CAST(floor(greatest(total_chars - done_chars, 0) / speed) AS BIGINT) END AS eta_seconds
        FROM fast LEFT JOIN total USING (job_id)""",
)
def _(s, d):
    totals = R.chunks(s, d, "job_id", "chars").groupBy("job_id").agg(F.sum(F.col("chars").cast("long")).alias("total_chars"))
    return telemetry.speed_series(R.attempts(s, d, *_POINT_COLUMNS), totals).select("job_id", "attempt_id", "point_no", "chars_per_min", "eta_seconds")


@_query(
    "latest_parts",
    """SELECT job_id, CAST(position AS INTEGER) AS position, part_id FROM (
            SELECT job_id, part_id, row_number() OVER (PARTITION BY job_id ORDER BY finished_at DESC NULLS LAST, part_id DESC) AS position FROM part WHERE job_id IS NOT NULL
        ) WHERE position <= 5""",
)
def _(s, d):
    return telemetry.recent(R.parts(s, d, "job_id", "finished_at")).select("job_id", "position", "part_id")


def _duration_sql(t: str) -> str:
    return f"CASE WHEN {t} >= 3600 THEN ({t} // 3600) || 'h ' || ({t} % 3600 // 60) || 'm' WHEN {t} >= 60 THEN ({t} // 60) || 'm ' || ({t} % 60) || 's' ELSE {t} || 's' END"


@_query(
    "provider_standing",
    _KEYS_SQL
    + f""", scene AS (SELECT provider, no, list(retry_in) FILTER (NOT dead) AS waits, bool_and(dead) AS gone, coalesce(bool_or(NOT dead AND retry_in * no <= 1), false) AS usable,
            coalesce(bool_and(kind = 'quota' AND retry_in * no > 1) FILTER (NOT dead), false) AS spent, coalesce(min(retry_in * no) FILTER (NOT dead), 1) - 1 AS rest
            FROM key_stat, (VALUES (0), (1), (2), (3)) v(no) GROUP BY ALL)
        SELECT provider, no, CASE WHEN gone AND no = 3 THEN 'disabled' WHEN NOT usable THEN 'all keys ' || CASE WHEN spent THEN 'out of quota' ELSE 'rate limited' END
            || ' (retry in ' || {_duration_sql("greatest(0, rest)")} || ')' WHEN no = 2 THEN 'cooling down (29s)' WHEN no = 1 THEN 'working' ELSE 'idle' END AS status FROM scene""",
)
def _(s, d):
    # the keys' pauses, as they are and longer, with the provider idle, at work, at rest and switched off
    scenes = telemetry.key_stats(R.attempts(s, d, *_KEY_COLUMNS)).withColumn("no", F.explode(F.array(*map(F.lit, range(4)))))
    until = (F.col("retry_in") * F.col("no")).cast("double")
    keys = scenes.groupBy("provider", "no").agg(F.collect_list(F.struct("dead", until.alias("cooldown_until"), "kind")).alias("keys"))
    off = F.forall("keys", lambda k: k["dead"]) & (F.col("no") == 3)
    status = telemetry.provider_status(F.col("keys"), off, F.when(F.col("no") == 2, 30.0).otherwise(0.0), (F.col("no") == 1).cast("int"), F.lit(1.0))
    return keys.select("provider", "no", status.alias("status"))


@_query("percents", "SELECT chunk_id, CASE WHEN coalesce(chars, 0) = 0 THEN 0.0 ELSE least(100.0, round_even(100.0 * least(chars, chunk_id % 977) / chars, 1)) END AS percent FROM chunk")
def _(s, d):
    rows = R.chunks(s, d, "chars")
    done = F.least(F.col("chars").cast("long"), F.col("chunk_id") % 977)
    return rows.select("chunk_id", progress.percent(done, F.col("chars"), F.lit(False)).alias("percent"))


@_query(
    "stream_progress",
    """SELECT epoch_us(attempted_at) // 300000000 * 300 AS span_start, provider, count(*) AS attempts,
            CAST(count_if(outcome = 'ok') AS BIGINT) AS done, CAST(coalesce(sum(chars) FILTER (outcome = 'ok'), 0) AS BIGINT) AS chars FROM attempt GROUP BY ALL""",
)
def _(s, d):
    import uuid

    path = f"{d}/attempts.parquet"
    schema = table(s, d, "attempts").schema
    # a stream reads folders: a single file is given by a pattern that only it matches
    stream = live.attempts_stream(s, path if os.path.isdir(path) else f"{d}/attempts.parque[t]", schema)
    name = f"progress_{uuid.uuid4().hex[:8]}"
    figures = live.drain(live.progress(stream), name, f"{shared_folder(s)}/leafstream/{name}")
    return figures.withColumn("span_start", F.unix_seconds("span_start"))


# ---- dispatch ----------------------------------------------------------------------------------------------


_ECHOED = r"regexp_replace(regexp_replace(translate(coalesce(txt, ''), 'يكى', 'یکی'), '^[" + _SPACE + r"]+', ''), '[" + _SPACE + r"]+\z', '')"
_SENT = r"FROM segment WHERE job_id IS NOT NULL AND regexp_matches(txt, '[\p{L}\p{Nl}\p{No}]')"


def _sent(s, d):
    rows = R.segments(s, d).where(T.is_translatable(F.col("text")) & F.col("job_id").isNotNull())
    plan = chunking.assemble(chunking.make_chunks(settle(rows.select("job_id", "seg_id", "text"), "segments"), "job_id"), "job_id")
    return plan.withColumnRenamed("job_id", "doc_id")


@_query("dispatched", f"SELECT CAST(job_id AS VARCHAR) AS doc_id, seg_id, md5({_ECHOED}) AS digest {_SENT}")
def _(s, d):
    services = [
        Provider("steady", concurrency=3),
        Provider("strict", concurrency=2),
        Provider("spent", keys=[Key("a"), Key("b")]),
        Provider("gone"),
    ]
    run = dispatch(_sent(s, d), services, Echo({"spent": "quota", "gone": "fatal", "strict": "format"}), Settings())
    return run.results.select("doc_id", "seg_id", F.md5("translation").alias("digest"))


@_query("given_up", f"SELECT CAST(job_id AS VARCHAR) AS doc_id, seg_id, 'other: as told' AS error {_SENT}")
def _(s, d):
    return dispatch(_sent(s, d), [Provider("a", concurrency=4), Provider("b", concurrency=4)], Echo({"a": "other", "b": "other"}), Settings(max_attempts=2)).failures


# ---- files -------------------------------------------------------------------------------------------------


def _files(s, d):
    """The documents as text files: UTF-8 without and with a mark, and UTF-16."""
    kind = F.col("doc_id") % 3
    utf8 = F.encode("text", "UTF-8")
    content = F.when(kind == 0, utf8).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(F.encode("text", "UTF-16"))
    rows = table(s, d, "documents").where("text IS NOT NULL")
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(".txt").alias("ext"), content.alias("content"), kind.alias("kind"))


@_query("decoded_files", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return sources.texts(_files(s, d)).select("doc_id", F.md5("text").alias("digest"))


@_query("file_hashes", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, left(sha256(text), 20) AS file_hash FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0")
def _(s, d):
    return _files(s, d).where("kind = 0").select("doc_id", T.file_hash(F.col("content")).alias("file_hash"))


def _made(s, d, ext, make):
    """Each chunk's texts as a file: (doc_id, ext, content). Characters that XML has no place for are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [make(texts) for texts in batch.column("texts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ext"), pa.array(content, pa.binary())], names=["doc_id", "ext", "content"])

    plain = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), "[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "")
    rows = R.chunks(s, d, "texts").select(F.col("chunk_id").cast("string").alias("doc_id"), F.lit(ext).alias("ext"), F.transform("texts", plain).alias("texts"))
    return settle(rows.mapInArrow(run, "doc_id string, ext string, content binary"), "files")


_XML_SQL = r"""replace(replace(regexp_replace(coalesce(txt, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"""


def _read_sql(body: str, shown: str = "t") -> str:
    """The segments read from files of the chunks' texts: those with something to render, numbered in their order."""
    return rf""", body AS (SELECT chunk_id, text_no, {body} AS t FROM segment)
        SELECT CAST(chunk_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY text_no) - 1 AS INTEGER) AS seg_id, md5({shown}) AS digest
        FROM body WHERE regexp_matches(t, '[\p{{L}}\p{{Nl}}\p{{No}}]')"""


def _stripped_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[{_SPACE}]+', ''), '[{_SPACE}]+\z', '')"


_SQUEEZED = _stripped_sql(rf"regexp_replace(regexp_replace({_XML_SQL}, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')")


def _digests(blocks):
    return blocks.where("problem IS NULL").select("doc_id", "seg_id", F.md5("text").alias("digest"))


def _again(files):
    """The files with their blocks in capitals, read again."""
    results = sources.blocks(files).select("doc_id", "seg_id", F.translate("text", _SMALL, _LARGE).alias("translation"))
    rebuilt = sources.rebuild(files, results).join(files.select("doc_id", "ext"), "doc_id")
    return _digests(sources.blocks(settle(rebuilt, "rebuilt")))


@_query("book_blocks", _read_sql(_SQUEEZED))
def _(s, d):
    return _digests(sources.blocks(_made(s, d, ".epub", books.from_texts)))


@_query("books_rebuilt", _read_sql(_SQUEEZED, _large("t")))
def _(s, d):
    return _again(_made(s, d, ".epub", books.from_texts))


@_query("word_paragraphs", _read_sql(_stripped_sql(_XML_SQL)))
def _(s, d):
    return _digests(sources.blocks(_made(s, d, ".docx", lambda texts: word.from_pages([texts]))))


@_query("word_rebuilt", _read_sql(_stripped_sql(_XML_SQL), _large("t")))
def _(s, d):
    return _again(_made(s, d, ".docx", lambda texts: word.from_pages([texts])))


@_query("pages_as_documents", _read_sql(_stripped_sql(_XML_SQL)))
def _(s, d):
    plain = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), "[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "")
    # each text on a page of its own
    pages = R.chunks(s, d, "texts").select(F.col("chunk_id").cast("string").alias("doc_id"), F.transform("texts", lambda t: F.array(plain(t))).alias("pages"))
    made = sources.pages_to_word(pages).withColumn("ext", F.lit(".docx"))
    return _digests(sources.blocks(settle(made, "built")))
