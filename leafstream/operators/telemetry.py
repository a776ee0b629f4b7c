"""A run's figures from its log of attempts: by provider and key, speed and time left, last parts, job states.

Nothing is ordered within one provider or job as a whole. Figures by key come from aggregates that combine before
they move; running figures are ordered within spans of time and carried over from one span to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstream.functions.progress import eta_seconds, percent
from leafstream.functions.providers import quota_pause, rate_pause
from leafstream.functions.text import duration

#: The span of time that a speed is taken over, and the points before a point that are kept at most.
SPAN_SECONDS, POINTS = 300, 400


def deduplicated(log: DataFrame, key: str, *latest_by: str) -> DataFrame:
    """One row for each key: the last by `latest_by`, whole rows deciding ties. Rows with a null key are left out."""
    rest = [c for c in log.columns if c != key]
    order = F.struct(*[F.col(c) for c in latest_by], *[c for c in rest if c not in latest_by and log.schema[c].dataType.typeName() != "map"])
    best = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def attempts_of(log: DataFrame) -> DataFrame:
    """The log with each attempt once, as logged last, and providers' names in one letter case."""
    once = deduplicated(log, "attempt_id", "logged_at")
    return once.withColumn("provider", F.lower(F.trim("provider")))


def provider_stats(attempts: DataFrame) -> DataFrame:
    """(provider, attempts, done, failed, chars, avg_seconds, keys_total, keys_dead) for each provider.

    `chars` counts what was rendered; a null counts as 0. A provider without any success has no average. Keys are
    told apart by their labels, and are dead once rejected.
    """
    ok = F.col("outcome") == "ok"
    # by key first: a few rows a provider, whatever its share of the log
    by_key = attempts.groupBy("provider", "key_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("done"),
        F.sum(F.when(ok, F.col("chars").cast("long"))).alias("chars"),
        F.sum(F.when(ok, F.col("seconds"))).alias("seconds"),
        F.count_if(F.col("outcome") == "auth").alias("auth"),
    )
    whole = by_key.groupBy("provider").agg(
        F.sum("n").alias("attempts"),
        F.sum("done").alias("done"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
        F.sum("seconds").alias("seconds"),
        F.count("key_label").alias("keys_total"),
        F.count_if((F.col("auth") > 0) & F.col("key_label").isNotNull()).alias("keys_dead"),
    )
    return whole.select(
        "provider",
        "attempts",
        "done",
        (F.col("attempts") - F.col("done")).alias("failed"),
        "chars",
        F.bround(F.col("seconds") / F.nullif("done", F.lit(0)), 1).alias("avg_seconds"),
        "keys_total",
        "keys_dead",
    )


def key_stats(attempts: DataFrame, now: Column | None = None) -> DataFrame:
    """(provider, key_label, uses, dead, kind, quota_hits, retry_in) for each key at the time `now`, the log's last
    moment by default.

    A success clears a key's last problem, a rate limit its count of quota reports. `retry_in` is the rest of its
    pause in whole seconds.
    """
    rows = attempts.where("key_label IS NOT NULL")
    key = ["provider", "key_label"]
    problem = F.col("outcome").isin("quota", "rate_limit", "auth")
    order = F.struct("attempted_at", "attempt_id")
    last = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("uses"),
        F.max(F.when(F.col("outcome") == "rate_limit", order)).alias("rate_at"),
        F.max(F.when(F.col("outcome") == "ok", order)).alias("ok_at"),
        F.max_by(F.struct("outcome", "retry_after", "attempted_at"), F.when(problem, order)).alias("last"),
        F.count_if(F.col("outcome") == "auth").alias("auth"),
        F.max("attempted_at").alias("seen"),
    )
    last = last.withColumn("problem_at", F.when(F.col("last").isNotNull(), F.col("last.attempted_at")))
    # quota reports after the last rate limit; rate limits in a row after the last success
    counted = (
        rows.where("outcome IN ('quota', 'rate_limit')")
        .join(last.select(*key, "rate_at", "ok_at"), key)
        .groupBy(*key)
        .agg(
            F.count_if((F.col("outcome") == "quota") & (F.col("rate_at").isNull() | (order > F.col("rate_at")))).alias("quota_hits"),
            F.count_if((F.col("outcome") == "rate_limit") & (F.col("ok_at").isNull() | (order > F.col("ok_at")))).alias("limits"),
        )
    )
    end = last.agg(F.max("seen")).scalar() if now is None else now
    both = last.join(counted, key, "left").withColumn("end", end)
    hits, limits = F.coalesce("quota_hits", F.lit(0)), F.coalesce("limits", F.lit(0))
    pause = F.when(F.col("last.outcome") == "quota", quota_pause(F.greatest(hits, F.lit(1)), F.col("last.retry_after"))).when(
        F.col("last.outcome") == "rate_limit", rate_pause(F.greatest(limits, F.lit(1)), F.col("last.retry_after"))
    )
    until = F.unix_micros("problem_at") / 1e6 + pause
    cleared = F.col("ok_at").isNotNull() & (F.col("ok_at.attempted_at") > F.col("problem_at"))
    left = F.greatest(F.lit(0), F.floor(until - F.unix_micros("end") / 1e6)).cast("long")
    return both.select(
        *key,
        "uses",
        (F.col("auth") > 0).alias("dead"),
        F.when(F.col("problem_at").isNull() | cleared, "").otherwise(F.col("last.outcome")).alias("kind"),
        hits.alias("quota_hits"),
        F.coalesce(left, F.lit(0).cast("long")).alias("retry_in"),
    )


def history(attempts: DataFrame, span: int = SPAN_SECONDS) -> DataFrame:
    """(job_id, attempt_id, at, chars, done_chars, point_no): the points of each job's progress, in order of time.

    Each finished chunk is a point; points count from 1. Sums are taken within spans of time, and the spans' totals
    carried on, so that a long job is no single task's work.
    """
    done = attempts.where("outcome = 'ok' AND job_id IS NOT NULL AND attempted_at IS NOT NULL").select(
        "job_id",
        "attempt_id",
        F.unix_micros("attempted_at").alias("at"),
        F.coalesce("chars", F.lit(0)).cast("long").alias("chars"),
        F.floor(F.unix_micros("attempted_at") / (span * 1_000_000)).alias("span"),
    )
    own = Window.partitionBy("job_id", "span").orderBy("at", "attempt_id").rowsBetween(Window.unboundedPreceding, 0)
    within = done.withColumn("sum", F.sum("chars").over(own)).withColumn("no", F.count(F.lit(1)).over(own))
    totals = done.groupBy("job_id", "span").agg(F.sum("chars").alias("t"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("job_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "job_id",
        "span",
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("points_before"),
    )
    joined = within.join(carried, ["job_id", "span"])
    return joined.select(
        "job_id",
        "attempt_id",
        "at",
        "chars",
        (F.col("chars_before") + F.col("sum")).alias("done_chars"),
        (F.col("points_before") + F.col("no")).alias("point_no"),
    )


def speed_series(attempts: DataFrame, totals: DataFrame, span: int = SPAN_SECONDS, points: int = POINTS) -> DataFrame:
    """For each point of :func:`history`: speed (characters a second), chars_per_min and eta_seconds at its time.

    The speed is taken from the first point of the last `span` seconds if these hold three or more, else from the
    oldest of the last `points`. With a single point or no gain there is none. `totals` gives each job's
    `total_chars`.
    """
    found = history(attempts, span)
    micros = span * 1_000_000
    # each point also stands in the next span, as what its points may look back to
    spanned = found.withColumn("span", F.floor(F.col("at") / micros))
    stands = spanned.withColumn("in_span", F.explode(F.array("span", F.col("span") + 1)))
    trailing = Window.partitionBy("job_id", "in_span").orderBy("at").rangeBetween(-micros, 0)
    first = F.min(F.struct("at", "point_no", "done_chars")).over(trailing)
    seen = (
        stands.withColumn("recent", F.count(F.lit(1)).over(trailing))
        .withColumn("first", first)
        .where("in_span = span")
    )
    # points of one moment later in the log are not yet there
    later = Window.partitionBy("job_id", "at")
    seen = seen.withColumn("recent", F.col("recent") - (F.max("point_no").over(later) - F.col("point_no")))
    oldest = found.select("job_id", F.col("point_no").alias("old_no"), F.col("at").alias("old_at"), F.col("done_chars").alias("old_chars"))
    back = seen.withColumn("old_no", F.greatest(F.lit(1), F.col("point_no") - (points - 1)))
    rows = back.join(oldest, ["job_id", "old_no"]).join(totals.select("job_id", "total_chars"), "job_id", "left")
    # the span's first point, unless older than the points kept
    near = (F.col("recent") >= 3) & (F.col("first.point_no") >= F.col("old_no"))
    start = F.when(near, F.col("first.at")).otherwise(F.col("old_at"))
    base = F.when(near, F.col("first.done_chars")).otherwise(F.col("old_chars"))
    gain, seconds = F.col("done_chars") - base, (F.col("at") - start) / 1e6
    speed = F.when((F.col("point_no") >= 2) & (F.col("done_chars") > 0) & (gain > 0) & (seconds > 0), gain / seconds)
    return rows.select(
        "job_id",
        "attempt_id",
        "point_no",
        "done_chars",
        speed.alias("speed"),
        F.floor(speed * 60).cast("long").alias("chars_per_min"),
        eta_seconds(F.col("total_chars"), F.col("done_chars"), speed).alias("eta_seconds"),
    )


def recent(parts: DataFrame, n: int = 5) -> DataFrame:
    """The last `n` parts of each job, newest first as `position` 1."""
    order = Window.partitionBy("job_id").orderBy(F.col("finished_at").desc(), F.col("part_id").desc())
    # the limit is applied within each partition before rows move
    ranked = parts.where("job_id IS NOT NULL").withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
    return ranked


def job_progress(jobs: DataFrame, segments: DataFrame, done: DataFrame) -> DataFrame:
    """(job_id, total_segments, done_segments, total_chars, done_chars, percent, status) for each job.

    `segments` are (job_id, seg_id, n_chars) and `done` (job_id, seg_id); jobs without segments are at 0 percent
    unless they are done.
    """
    marked = segments.join(done.select("job_id", "seg_id").distinct().withColumn("d", F.lit(1)), ["job_id", "seg_id"], "left")
    sums = marked.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("d").alias("finished"),
        F.sum("n_chars").alias("total_chars"),
        F.sum(F.when(F.col("d") == 1, F.col("n_chars")).otherwise(0)).alias("done_chars"),
    )
    rows = jobs.select("job_id", "status").join(sums, "job_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return rows.select(
        "job_id",
        zero("total").alias("total_segments"),
        zero("finished").alias("done_segments"),
        zero("total_chars").alias("total_chars"),
        zero("done_chars").alias("done_chars"),
        percent(zero("done_chars"), zero("total_chars"), F.coalesce(F.col("status") == "done", F.lit(False))).alias("percent"),
        "status",
    )


def provider_status(keys: DataFrame, disabled: Column, cooling_until: Column, busy: Column, now: Column) -> Column:
    """How a provider stands, in words, from an array `keys` of struct(dead, cooldown_until, kind) and its state."""
    live = F.filter(keys, lambda k: ~k["dead"])
    usable = F.exists(keys, lambda k: ~k["dead"] & (k["cooldown_until"] <= now))
    quota_only = (F.size(live) > 0) & F.forall(live, lambda k: (k["kind"] == "quota") & (k["cooldown_until"] > now))
    wait = F.coalesce(F.array_min(F.transform(live, lambda k: k["cooldown_until"])), now) - now
    what = F.when(quota_only, "out of quota").otherwise("rate limited")
    parked = F.concat(F.lit("all keys "), what, F.lit(" (retry in "), duration(wait), F.lit(")"))
    cooling = F.concat(F.lit("cooling down ("), (cooling_until - now).cast("int").cast("string"), F.lit("s)"))
    return (
        F.when(disabled, "disabled").when(~usable, parked).when(cooling_until > now, cooling).when(busy > 0, "working").otherwise("idle")
    )


def earliest_retry(keys: DataFrame) -> DataFrame:
    """(retry_in, provider) of the key that can be used again first, over all providers' live keys; no row without
    any. `keys` are as :func:`key_stats` gives them."""
    live = keys.where("NOT dead")
    first = live.groupBy("provider").agg(F.min("retry_in").alias("retry_in"))
    return first.agg(F.min(F.struct("retry_in", "provider")).alias("r")).where("r IS NOT NULL").select("r.*")


def log_tail(lines: DataFrame, most: int = 2000, keep: int = 1500) -> DataFrame:
    """A log's lines (line_no, line): the last `keep` once there are more than `most`."""
    count, last = lines.agg(F.count(F.lit(1))).scalar(), lines.agg(F.max("line_no")).scalar()
    return lines.where((count <= most) | (F.col("line_no") > last - keep))
