"""Splitting of oversized text elements by content-defined chunking.

A rolling hash over the last ``WINDOW`` characters marks landmarks that depend on nothing but the text near
them; each landmark moves to the nearest natural boundary. A piece ends at the first such place between the
least and the greatest size, so that an edit alters only the pieces around it: behind it the same landmarks
end the same pieces. Where a window holds no landmark, its last boundary of the strongest kind ends the piece.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstream.llm.values import once, text_elements

WINDOW = 16
DEFAULT_MAX_CHARS = 2500

#: Boundaries by falling strength; a match's end is the place of the cut.
KINDS = ("paragraph", "line", "sentence", "clause", "word")
_PATTERNS = (
    regex.compile(r"\n[^\S\n]*\n\s*|\r\n[^\S\n]*\r\n\s*"),
    regex.compile(r"(?:\r\n|[\n\r\u0085\u2028\u2029])+"),
    regex.compile(r"[.!?…؟۔]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*\s*"),
    regex.compile(r"[,;:،؛—–]+[\"'”’»)\]]*\s+|[，；：、]+\s*"),
    regex.compile(r"\s+"),
)
_GRAPHEME = regex.compile(r"\X")


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    overlap: int
    boundary: str


def _rolling(text: str) -> np.ndarray:
    """For each place the hash of the WINDOW characters before it, in log2(WINDOW) vector steps."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = (codes + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    span = 1
    factor = 0x100000001B3
    while span < WINDOW:
        moved = np.zeros_like(h)
        moved[span:] = h[:-span] if span < len(h) else h[:0]
        h = h + moved * np.uint64(factor)
        factor = factor * factor % 2**64
        span *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _boundaries(text: str) -> list[np.ndarray]:
    return [np.fromiter((m.end() for m in p.finditer(text)), dtype=np.int64) for p in _PATTERNS]


def _whole(text: str, start: int, at: int) -> int:
    """The last place up to `at` that cuts no grapheme; `at` itself if one grapheme fills the whole piece."""
    last = start
    for m in _GRAPHEME.finditer(text, start):
        if m.end() > at:
            break
        last = m.end()
    return last if last > start else at


def split(text: str, max_chars: int, overlap_chars: int = 0) -> list[Piece]:
    """The pieces of `text`, none longer than `max_chars`.

    Consecutive pieces share up to `overlap_chars` characters: the shared part begins at the first boundary
    within that reach, or exactly there where it holds none. An overlap of `max_chars` or more is taken as one less,
    so that each piece brings something new. A text within the limit is one piece. The pieces
    without their overlaps, joined, are the text again.
    """
    max_chars = max(1, max_chars)
    if len(text) <= max_chars:
        return [Piece(0, len(text), 0, "end")]
    overlap_chars = min(max(0, overlap_chars), max_chars - 1)
    most = max_chars - overlap_chars
    least = max(1, most // 2)
    kinds = _boundaries(text)
    strong = np.unique(np.concatenate(kinds[:3])) if any(map(len, kinds[:3])) else np.empty(0, np.int64)
    weak = kinds[3] if len(kinds[3]) else np.empty(0, np.int64)
    word = kinds[4]
    # about four landmarks between the least and the greatest size
    spacing = max(1, (most - least) // 4)
    marks = np.nonzero(_rolling(text) % np.uint64(spacing) == 0)[0] + 1
    marks = marks[marks >= WINDOW]
    reach = max(8, spacing)
    cuts = _snap(marks, (strong, weak, word), reach)
    pieces: list[Piece] = []
    begins: list[int] = []
    start = 0
    while start < len(text):
        low, high = start + least, start + most
        first_high = start + (max_chars if not pieces else most)
        if len(text) <= first_high:
            end, kind = len(text), "end"
        else:
            end, kind = _end(text, start, low, high, cuts, kinds)
        shared = _shared(text, start, overlap_chars, kinds, begins) if pieces else 0
        pieces.append(Piece(start - shared, end, shared, kind))
        begins.append(start)
        start = end
    return pieces


def _snap(marks: np.ndarray, kinds: tuple[np.ndarray, ...], reach: int) -> np.ndarray:
    """Each landmark's nearest boundary of the strongest kind within reach; landmarks without one are dropped."""
    found = np.full(len(marks), -1, dtype=np.int64)
    for places in kinds:
        if not len(places) or not len(marks):
            continue
        after = np.searchsorted(places, marks)
        left = places[np.maximum(after - 1, 0)]
        right = places[np.minimum(after, len(places) - 1)]
        near = np.where(np.abs(marks - left) <= np.abs(right - marks), left, right)
        found = np.where((found < 0) & (np.abs(near - marks) <= reach), near, found)
    return np.unique(found[found > 0])


def _end(text: str, start: int, low: int, high: int, cuts: np.ndarray, kinds: list[np.ndarray]) -> tuple[int, str]:
    at = np.searchsorted(cuts, low)
    if at < len(cuts) and cuts[at] <= high:
        end = int(cuts[at])
        name = next(n for n, places in zip(KINDS, kinds) if _holds(places, end))
        return end, name
    for name, places in zip(KINDS, kinds):
        at = np.searchsorted(places, high, side="right") - 1
        if at >= 0 and places[at] >= low:
            return int(places[at]), name
    return _whole(text, start, high), "none"


def _holds(places: np.ndarray, value: int) -> bool:
    at = np.searchsorted(places, value)
    return bool(at < len(places) and places[at] == value)


def _shared(text: str, start: int, overlap: int, kinds: list[np.ndarray], begins: list[int]) -> int:
    if not overlap:
        return 0
    low = start - overlap
    if low <= 0:
        return start
    best = start
    for places in kinds:
        at = np.searchsorted(places, low)
        if at < len(places) and places[at] < best:
            best = int(places[at])
    if best == start:
        best = low
        # from a place that is known to cut no grapheme
        for m in _GRAPHEME.finditer(text, begins[bisect.bisect_right(begins, low) - 1]):
            if m.start() >= low:
                best = m.start()
                break
    return max(0, start - min(best, start))


def with_limits(chunks: DataFrame, jobs: DataFrame, settings: DataFrame) -> DataFrame:
    """(chunk_id, text_no, text, max_chars, overlap_chars) of the elements over their job's limit.

    A job or setting that is missing, or a null limit, means the default; a null overlap means none. Elements
    within the least limit of all settings are left out before any join, so that only long ones move.
    """
    limits = settings.where(F.col("settings_id").isNotNull()).groupBy("settings_id").agg(
        F.min(F.coalesce("max_chars", F.lit(DEFAULT_MAX_CHARS))).alias("max_chars"),
        F.max(F.coalesce("overlap_chars", F.lit(0))).alias("overlap_chars"),
    )
    least = limits.agg(F.least(F.lit(DEFAULT_MAX_CHARS), F.min("max_chars"))).scalar()
    long = once(
        text_elements(chunks, "job_id", keep=F.length("text") > least),
        "chunk_id",
        "text_no",
    )
    of_job = (
        jobs.where(F.col("job_id").isNotNull())
        .groupBy("job_id")
        .agg(F.min("settings_id").alias("settings_id"))
        .join(limits, "settings_id", "left")
    )
    return (
        long.join(of_job, "job_id", "left")
        .select(
            "chunk_id",
            "text_no",
            "text",
            F.coalesce("max_chars", F.lit(DEFAULT_MAX_CHARS)).alias("max_chars"),
            F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"),
        )
        .where(F.length("text") > F.col("max_chars"))
    )


PIECES = (
    "chunk_id bigint, text_no int, piece_no int, char_start int, char_end int, "
    "overlap int, boundary string, piece string"
)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("chunk_id", "text_no", "text", "max_chars", "overlap_chars")]
        out: list[list] = [[] for _ in names]
        for chunk_id, text_no, text, limit, overlap in zip(*columns):
            for no, p in enumerate(split(text, limit, overlap)):
                row = (chunk_id, text_no, no, p.start, p.end, p.overlap, p.boundary, text[p.start : p.end])
                for column, value in zip(out, row):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


def split_oversized(chunks: DataFrame, jobs: DataFrame, settings: DataFrame) -> DataFrame:
    """The pieces of each over-long element of ``chunks.texts``, in order (see :data:`PIECES`).

    Elements within the limit, nulls and empty texts give no rows; a chunk that was delivered again counts
    once; columns beyond the named ones are ignored.
    """
    return with_limits(chunks, jobs, settings).mapInArrow(_pieces, PIECES)


def oversized_found(chunks: DataFrame, jobs: DataFrame, settings: DataFrame) -> DataFrame:
    """(chunk_id, text_no) of the elements that came out in more than one piece."""
    return split_oversized(chunks, jobs, settings).where("piece_no = 1").select("chunk_id", "text_no")
