"""Progress figures as column expressions, and the speed of a run that goes on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(done_chars: Column, total_chars: Column, finished: Column) -> Column:
    """How much is done, to one decimal (a half to even), at most 100; 0 where there is nothing to do."""
    share = F.bround(100 * done_chars / F.nullif(total_chars, F.lit(0)), 1)
    return F.when(finished, F.lit(100.0)).otherwise(F.least(F.lit(100.0), F.coalesce(share, F.lit(0.0))))


def eta_seconds(total_chars: Column, done_chars: Column, speed: Column) -> Column:
    """Whole seconds left at a speed in characters a second; null without one."""
    left = F.greatest(total_chars - done_chars, F.lit(0))
    return F.when(speed > 0, F.floor(left / speed).cast("long"))


def rate(points: list[tuple[float, int]], now: float, span: float = 300.0) -> float | None:
    """Characters a second from the points (time, characters so far) of the last `span` seconds, if these are three or
    more, else from all; None without any gain."""
    if len(points) < 2:
        return None
    near = [p for p in points if p[0] >= now - span]
    (since, before), (last, after) = (near if len(near) >= 3 else points)[0], points[-1]
    gain, seconds = after - before, max(now, last) - since
    return gain / seconds if gain > 0 and seconds > 0 else None


def words(seconds: float) -> str:
    """``functions.text.duration`` for a single number."""
    s = max(0, int(seconds))
    return f"{s // 3600}h {s % 3600 // 60}m" if s >= 3600 else f"{s // 60}m {s % 60}s" if s >= 60 else f"{s}s"
