"""Cutting texts into segments: long blocks, plain text, subtitles and pages.

Each function works on a row by itself, with higher-order functions, so that segmenting moves no data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstream.functions.text import SPACE, is_translatable, leading, strip

#: The longest piece of a paragraph of plain text or of a page.
PARAGRAPH = 4000
_BLANK_LINE = rf"\n[{SPACE}]*\n"
_SENTENCE_END = rf"(?<=[.!?…。！？])[{SPACE}]+"
_TIMECODE = r"\p{Nd}{1,2}:\p{Nd}{2}:\p{Nd}{2}[,.]\p{Nd}{1,3}[ \t]*-->[ \t]*\p{Nd}{1,2}:\p{Nd}{2}:\p{Nd}{2}[,.]\p{Nd}{1,3}"
_STOPS = rf"[.!?…:;\"'»”)\]][{SPACE}]*\z"
RTL_MARK = "\u200f"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: lambdas would compute what they capture at each step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def newlines(text: Column) -> Column:
    """A text with line feeds as its only line ends."""
    return F.regexp_replace(text, r"\r\n|\r", "\n")


def split_long(text: Column, most: int) -> Column:
    """The pieces of a text longer than `most`: its lines, or its sentences if it is one line, put together as
    long as they fit. A line or sentence that is longer by itself stays whole; null gives null."""
    return F.when(text.isNotNull(), let(text, lambda t: F.when(F.length(t) <= most, F.array(t)).otherwise(_pieces(t, most))))


def _pieces(text: Column, most: int) -> Column:
    """First the places where pieces begin, from lengths alone; then each piece as a slice of the units."""
    lined = F.contains(text, F.lit("\n"))
    units = F.when(lined, F.split(text, "\n", -1)).otherwise(F.split(text, _SENTENCE_END, -1))
    joint = F.when(lined, F.lit("\n")).otherwise(F.lit(" "))
    return let(F.struct(units.alias("units"), joint.alias("joint")), lambda x: _joined(x["units"], x["joint"], most))


def _joined(units: Column, joint: Column, most: int) -> Column:
    state = lambda at, size, begins: F.struct(at.alias("at"), size.alias("size"), begins.alias("begins"))

    def add(a: Column, n: Column) -> Column:
        # blank units at a piece's beginning are left out of it
        begin = (a["size"] == 0) | (a["size"] + n + 1 > most)
        begins = F.when(begin & (n > 0), F.array_append(a["begins"], a["at"])).otherwise(a["begins"])
        # a piece that ends at a blank unit is closed there
        ended = F.when(begin & (n == 0) & (a["size"] > 0), F.array_append(begins, -a["at"] - 1)).otherwise(begins)
        return state(a["at"] + 1, F.when(begin, n).otherwise(a["size"] + n + 1), ended)

    lengths = F.transform(units, F.length)
    begins = F.aggregate(lengths, state(F.lit(0), F.lit(0), F.array().cast("array<int>")), add, lambda a: F.array_append(a["begins"], a["at"]))

    def cut(places: Column) -> Column:
        spans = F.transform(F.slice(places, 1, F.size(places) - 1), lambda p, i: F.struct(p.alias("a"), F.get(places, i + 1).alias("b")))
        end = lambda p: F.when(p < 0, -p - 1).otherwise(p)
        piece = lambda x: F.call_function("array_join", F.slice(units, x["a"] + 1, end(x["b"]) - x["a"]), joint)
        return F.transform(F.filter(spans, lambda x: x["a"] >= 0), piece)

    return let(begins, cut)


# ---- layouts: what stays, and what is rendered -----------------------------------------------------------------


def _token(text: Column, rendered: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(rendered).alias("seg"))


def _layout(tokens: Column) -> Column:
    """struct(glue, pieces): the texts to be rendered, and what stands before each and after the last. Joined in turn,
    they are the text again."""

    def made(t: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(t, i)["seg"])
        places = F.when(F.size(t) > 0, places).otherwise(F.array().cast("array<int>"))
        return let(places, lambda at: parts(t, at))

    def parts(t: Column, at: Column) -> Column:
        texts = lambda start, n: F.array_join(F.transform(F.slice(t, start + 1, n), lambda x: x["text"]), "")

        def between(k: Column) -> Column:
            start = F.when(k == 0, 0).otherwise(F.get(at, k - 1) + 1)
            return texts(start, F.coalesce(F.get(at, k), F.size(t)) - start)

        glue = F.transform(F.sequence(F.lit(0), F.size(at)), between)
        return F.struct(glue.alias("glue"), F.transform(at, lambda i: F.get(t, i)["text"]).alias("pieces"))

    return let(tokens, made)


def paragraphs(text: Column) -> Column:
    """array<struct<raw, seg>>: the paragraphs of a text and the blank lines between them in turn; `seg` says that
    there is something to render."""
    both = F.arrays_zip(F.split(text, _BLANK_LINE, -1).alias("part"), F.regexp_extract_all(text, F.lit(f"({_BLANK_LINE})"), 1).alias("gap"))
    item = lambda raw, seg: F.struct(raw.alias("raw"), seg.alias("seg"))
    pair = lambda x: F.array(item(x["part"], is_translatable(x["part"])), item(F.coalesce(x["gap"], F.lit("")), F.lit(False)))
    return F.flatten(F.transform(both, pair))


def text_layout(text: Column, most: int = PARAGRAPH) -> Column:
    """The layout of a plain text, as struct(glue, pieces), its line ends made line feeds; null for a null.

    A paragraph with something to render is a piece, or several if it is long; all else stays as it is.
    """

    def tokens(p: Column) -> Column:
        return F.when(p["seg"], let(strip(p["raw"]), lambda body: cut(p["raw"], body))).otherwise(F.array(_token(p["raw"], False)))

    def cut(raw: Column, body: Column) -> Column:
        joint = F.when(F.contains(body, F.lit("\n")), F.lit("\n")).otherwise(F.lit(" "))
        each = F.transform(
            split_long(body, most), lambda x, i: F.when(i == 0, F.array(_token(x, True))).otherwise(F.array(_token(joint, False), _token(x, True)))
        )
        lead = F.length(leading(raw))
        after = F.substring(raw, lead + F.length(body) + 1, F.length(raw))
        return F.concat(F.array(_token(F.left(raw, lead), False)), F.flatten(each), F.array(_token(after, False)))

    return F.when(text.isNotNull(), _layout(F.flatten(F.transform(paragraphs(newlines(text)), tokens))))


def text_layouts(documents: DataFrame, key: str = "doc_id", text: str = "text", most: int = PARAGRAPH) -> DataFrame:
    """(key, layout): the layouts of plain texts. Rows with a null key or text are left out."""
    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return rows.select(key, text_layout(F.col(text), most).alias("layout"))


def segments_of(layouts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seg_id, text): the pieces of layouts, numbered in their order, which moves nothing."""
    return layouts.select(key, F.posexplode("layout.pieces").alias("seg_id", "text"))


def cues_of(text: Column) -> Column:
    """array<struct<header, body>>: the blocks of a subtitle file. The header ends with the first line that has a
    timecode; a block without one is all header, with a null body. Right-to-left marks in a body are dropped."""

    def block(lines: Column) -> Column:
        timed = F.array_min(F.transform(lines, lambda line, i: F.when(F.rlike(line, F.lit(_TIMECODE)), i)))
        return let(F.coalesce(timed, F.lit(-1)), lambda at: cut(lines, at))

    def cut(lines: Column, at: Column) -> Column:
        body = F.replace(F.array_join(F.slice(lines, at + 2, F.size(lines)), "\n"), F.lit(RTL_MARK), F.lit(""))
        head = F.when(at < 0, lines).otherwise(F.slice(lines, F.lit(1), at + 1))
        return F.struct(head.alias("header"), F.when(at >= 0, body).alias("body"))

    plain = F.regexp_replace(newlines(text), r"^\n+|\n+\z", "")
    return F.transform(F.split(plain, _BLANK_LINE, -1), lambda b: let(F.split(b, "\n", -1), block))


def subtitle_cues(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, cue_no, header, body, translatable): a row for each block of subtitles between blank lines."""
    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    cues = rows.select(key, F.posexplode(cues_of(F.col(text))).alias("cue_no", "_c"))
    return cues.select(key, "cue_no", "_c.header", "_c.body", is_translatable(F.col("_c.body")).alias("translatable"))


def subtitle_layouts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, layout): subtitles as layouts, whose pieces are the bodies with something to render, each with the line
    end before it left out of the glue (see ``layouts.build_subtitles``)."""

    def tokens(c: Column, i: Column) -> Column:
        head = F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit("\n\n")), F.array_join(c["header"], "\n"))
        rest = F.when(F.coalesce(c["body"], F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("\n"), c["body"]))
        return F.when(is_translatable(c["body"]), F.array(_token(head, False), _token(c["body"], True))).otherwise(F.array(_token(F.concat(head, rest), False)))

    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    every = F.flatten(F.transform(cues_of(F.col(text)), tokens))
    return rows.select(key, _layout(F.concat(every, F.array(_token(F.lit("\n"), False)))).alias("layout"))


def page_paragraphs(text: Column) -> Column:
    """The paragraphs of a page's text, its broken lines glued together, as an array.

    A paragraph ends at a blank line, at a short line that ends a sentence, or at a very short one before a line
    that begins with a capital letter; short is against the line length that four fifths of the lines don't
    exceed. A word broken by a hyphen at a line's end is joined.
    """
    clean = lambda x: strip(F.regexp_replace(x, r"[ \t\xa0]+", " "))
    return let(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n", -1), clean), _glued)


def _glued(lines: Column) -> Column:
    lengths = F.array_sort(F.transform(F.filter(lines, lambda x: x != ""), F.length))
    typical = let(lengths, lambda n: F.coalesce(F.get(n, F.floor(F.size(n) * F.lit(0.8)).cast("int")), F.lit(0)))
    # each line with the next one that isn't blank, found from the end
    behind = lambda out, following: F.struct(out.alias("out"), following.alias("following"))
    pair = lambda line, following: F.struct(line.alias("line"), following.alias("following"))
    paired = F.aggregate(
        F.reverse(lines),
        behind(F.array().cast("array<struct<line:string,following:string>>"), F.lit("")),
        lambda a, x: behind(
            F.array_append(a["out"], pair(x, a["following"])), F.when(x == "", a["following"]).otherwise(x)
        ),
        lambda a: F.reverse(a["out"]),
    )
    state = lambda paras, current, usual: F.struct(paras.alias("paras"), current.alias("current"), usual.alias("usual"))

    def add(a: Column, p: Column) -> Column:
        line, current, usual = p["line"], a["current"], a["usual"]
        hyphen = F.rlike(current, F.lit(r"(?s)(^|[^ ])-\z")) & F.rlike(line, F.lit(r"^\p{Ll}"))
        longer = (
            F.when(current == "", line)
            .when(hyphen, F.concat(F.left(current, F.length(current) - 1), line))
            .otherwise(F.concat(current, F.lit(" "), line))
        )
        short = F.length(line) < usual * 0.75
        capital = F.rlike(p["following"], F.lit(r"^\p{Lu}")) & (F.length(line) < usual * 0.5)
        ends = short & (F.rlike(line, F.lit(_STOPS)) | capital)
        closed = F.when(current == "", a["paras"]).otherwise(F.array_append(a["paras"], current))
        return (
            F.when(line == "", state(closed, F.lit(""), usual))
            .when(ends, state(F.array_append(a["paras"], longer), F.lit(""), usual))
            .otherwise(state(a["paras"], longer, usual))
        )

    last = lambda a: F.when(a["current"] == "", a["paras"]).otherwise(F.array_append(a["paras"], a["current"]))
    return F.aggregate(paired, state(F.array().cast("array<string>"), F.lit(""), typical), add, last)


def drop_running_headers(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages (key, page_no, paragraphs) without the first or last paragraphs that recur, but for digits, on at
    least half of a document's pages; documents of less than four pages stay as they are.

    Counting is by document and edge text, so that a document of many pages is counted in parts.
    """
    shape = lambda c: F.regexp_replace(c, r"\p{Nd}+", "#")
    first, last = F.get("paragraphs", F.lit(0)), F.get("paragraphs", F.size("paragraphs") - 1)
    counts = pages.groupBy(key).agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages >= 4")
    edges = pages.select(key, F.explode(F.array_distinct(F.array_compact(F.array(first, last)))).alias("edge"))
    frequent = (
        edges.where(F.length("edge") < 80)
        .groupBy(key, shape(F.col("edge")).alias("edge"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(counts, key)
        .where("n >= n_pages * 0.5")
    )
    # at most two of a document's edges recur on half of its pages or more
    common = frequent.groupBy(key).agg(F.collect_set("edge").alias("_common"))
    marked = pages.join(common, key, "left")
    known = F.coalesce(F.col("_common"), F.array().cast("array<string>"))
    rest = F.when(F.coalesce(F.array_contains(known, shape(first)), F.lit(False)), F.slice("paragraphs", F.lit(2), F.size("paragraphs"))).otherwise(F.col("paragraphs"))
    shortened = marked.select(key, "page_no", rest.alias("paragraphs"), known.alias("_common"))
    last = F.get("paragraphs", F.size("paragraphs") - 1)
    kept = F.when(F.coalesce(F.array_contains("_common", shape(last)), F.lit(False)), F.slice("paragraphs", F.lit(1), F.size("paragraphs") - 1))
    return shortened.select(key, "page_no", kept.otherwise(F.col("paragraphs")).alias("paragraphs"))
