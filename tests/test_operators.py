"""Checkpoint, providers, telemetry."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from leafstream.functions.text import segment_hash
from leafstream.operators import cache, telemetry
from leafstream.operators import providers as pools

DAY = dt.datetime(2024, 5, 1)


def entries(spark, rows):
    frame = spark.createDataFrame(rows, "file_hash string, mode string, text string, translation string, at int")
    return frame.select("file_hash", "mode", segment_hash(F.col("text")).alias("seg_sha1"), "translation", F.timestamp_seconds("at").alias("written_at"))


def test_checkpoint(spark, tmp_path):
    known = entries(spark, [("f", "translate", "a", "old", 1), ("f", "translate", "a", "new", 2), ("f", "refine", "b", "other", 1), ("f", "translate", None, "x", 1), ("f", "translate", "c", None, 1)])
    segments = spark.createDataFrame([("f", "translate", 0, "a"), ("f", "translate", 1, "b"), ("f", "translate", 2, "a"), ("f", "translate", 3, None)], "file_hash string, mode string, seg_id int, text string")
    found = {r["seg_id"]: r["translation"] for r in cache.lookup(segments, known).collect()}
    assert found == {0: "new", 1: None, 2: "new", 3: None}
    assert sorted(r["seg_id"] for r in cache.pending(segments, known).collect()) == [1, 3]
    path = str(tmp_path / "kept")
    assert cache.read(spark, path).count() == 0
    for _ in range(2):  # the same results twice
        cache.write(known.where("translation IS NOT NULL AND seg_sha1 IS NOT NULL"), path)
    assert {tuple(r) for r in cache.latest(cache.read(spark, path)).collect()} == {tuple(r) for r in cache.latest(known).collect()}


def test_merge(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "seg_id int, translation string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "seg_id int, translation string")
    assert {tuple(r) for r in cache.merge(old, new, ["seg_id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


PROVIDER = "name string, base_url string, api_key string, model string, concurrency int, enabled boolean, extra_headers map<string,string>, use_for array<string>"


def test_configured(spark):
    raw = spark.createDataFrame(
        [
            ("a", "http://a/", "k1,k2 k1", "m", None, None, None, None),
            (None, "http://b", None, "m", 0, True, {}, []),
            ("c", " ", "k", "m", 2, True, {}, ["review"]),
            ("d", "http://d", "k", None, 2, False, {}, ["x"]),
            ("e", "http://e", "k", "m", 2, True, {}, ["all"]),
            ("e", "http://e", "k", "m", 2, True, {}, ["t"]),
        ],
        PROVIDER,
    )
    rows = {(r["name"], r["problem"]): r for r in pools.configured(raw).collect()}
    assert rows["a", None]["keys"] == ["k1", "k2"] and rows["a", None]["concurrency"] == 1
    assert ("provider", None) in rows and ("c", "no URL") in rows and ("d", "no model") in rows and ("e", "name is not unique") in rows
    configured = pools.configured(raw)
    assert sorted(r["name"] for r in pools.used_for(configured, F.lit("refine")).collect()) == ["a", "provider"]
    assert {r["name"]: r["note"] for r in pools.skipped(pools.configured(raw.where("name = 'e'").limit(1).unionByName(raw.where("name = 'a'"))), F.lit("refine")).collect()} == {}
    labels = [(r["name"], r["key_no"], r["key_label"]) for r in pools.endpoints(configured.where("name IN ('a', 'provider')")).orderBy("name", "key_no").collect()]
    assert labels == [("a", 0, "…"), ("a", 1, "…"), ("provider", 0, "(no key)")]


def test_upsert(spark):
    running = spark.createDataFrame(
        [("a", "http://a", ["k"], "m", 2, False, ""), ("b", "http://b", ["k"], "m", 1, True, "wrong model"), ("c", "http://c", ["k"], "m", 1, True, "all keys were rejected")],
        "name string, base_url string, keys array<string>, model string, concurrency int, disabled boolean, disabled_reason string",
    )
    changes = spark.createDataFrame(
        [("a", "http://z", ["k", "l"], "n", 1, True, None), ("b", "http://b", ["k"], "n", 3, True, None), ("c", "http://c", ["j"], "m", 1, True, None), ("d", "http://d", ["k"], "m", 1, True, None), ("x", "http://x", ["k"], "m", 1, False, None)],
        "name string, base_url string, keys array<string>, model string, concurrency int, enabled boolean, problem string",
    )
    rows = {r["name"]: r for r in pools.upsert(running, changes).collect()}
    assert set(rows) == {"a", "b", "c", "d"}
    assert (rows["a"]["base_url"], rows["a"]["keys"], rows["a"]["concurrency"], rows["a"]["model"]) == ("http://a", ["k", "l"], 2, "m")
    assert rows["b"]["revived"] and rows["b"]["model"] == "n" and rows["b"]["concurrency"] == 3 and not rows["b"]["disabled"]
    assert rows["c"]["revived"] and rows["c"]["keys"] == ["k", "j"] and rows["d"]["is_new"]
    waiting = {r["name"]: r["keys"] for r in pools.upsert_waiting(running.select("name", "base_url", "keys", "model", "concurrency"), changes).collect()}
    assert waiting == {"a": ["k", "l"], "b": ["k"], "c": ["k", "j"], "d": ["k"]}


ATTEMPT = "attempt_id long, chunk_id long, job_id long, provider string, key_label string, outcome string, retry_after double, seconds double, chars int, attempted_at timestamp, logged_at timestamp"


def log(spark, rows):
    return spark.createDataFrame(
        [(i, i, job, p, k, o, w, s, c, DAY + dt.timedelta(seconds=t), DAY + dt.timedelta(seconds=t)) for i, (job, p, k, o, w, s, c, t) in enumerate(rows, 1)], ATTEMPT
    )


def test_stats(spark):
    rows = [(1, "A", "k1", "ok", None, 2.0, 10, 1), (1, "a ", "k1", "ok", None, 2.5, None, 2), (1, "a", "k2", "auth", None, None, None, 3), (1, "b", None, "transient", None, None, None, 4)]
    frame = log(spark, rows)
    found = {r["provider"]: tuple(r)[1:] for r in telemetry.provider_stats(telemetry.attempts_of(frame.unionByName(frame))).collect()}
    assert found == {"a": (3, 2, 1, 10, 2.2, 2, 1), "b": (1, 0, 1, 0, None, 0, 0)}
    assert telemetry.provider_stats(frame.limit(0)).count() == 0


def test_keys(spark):
    rows = [
        (1, "a", "k", "quota", None, None, None, 0), (1, "a", "k", "rate_limit", None, None, None, 10), (1, "a", "k", "quota", None, None, None, 20), (1, "a", "k", "quota", None, None, None, 30),
        (1, "a", "m", "rate_limit", 50.0, None, None, 20), (1, "a", "n", "quota", None, None, None, 10), (1, "a", "n", "ok", None, 1.0, 5, 20), (1, "b", "x", "auth", None, None, None, 30),
    ]
    found = {(r["provider"], r["key_label"]): tuple(r)[2:] for r in telemetry.key_stats(log(spark, rows)).collect()}
    assert found["a", "k"] == (4, False, "quota", 2, 3600)
    assert found["a", "m"] == (1, False, "rate_limit", 0, 40)
    first = telemetry.earliest_retry(telemetry.key_stats(log(spark, rows))).first()
    assert (first["retry_in"], first["provider"]) == (40, "a")
    assert telemetry.earliest_retry(telemetry.key_stats(log(spark, rows).limit(0))).count() == 0
    assert found["a", "n"][2] == "" and found["b", "x"][:3] == (1, True, "auth")


def model_speed(points, total, span=300, most=400):
    out, seen = [], []
    for t, c in points:
        seen.append((t, c))
        kept = seen[-most:]
        near = [p for p in kept if p[0] >= t - span]
        t0, c0 = near[0] if len(near) >= 3 else kept[0]
        speed = (c - c0) / (t - t0) if len(kept) >= 2 and c > c0 and t > t0 else None
        out.append((speed and int(speed * 60), None if not speed else int(max(0, total - c) / speed)))
    return out


def test_speed_against_model(spark):
    rnd = random.Random(2)
    rows, expected, totals = [], {}, []
    for job in range(6):
        t, c, points = 0, 0, []
        for _ in range(rnd.randint(1, 60)):
            t += rnd.choice([1, 30, 200, 700, 1500])
            n = rnd.choice([0, 10, 400])
            c += n
            points.append((t, c))
            rows.append((job, "a", "k", "ok", None, 1.0, n, t))
        expected[job] = model_speed(points, 20_000, most=8)
        totals.append((job, 20_000))
    frame = telemetry.speed_series(log(spark, rows), spark.createDataFrame(totals, "job_id long, total_chars long"), points=8)
    found: dict[int, list] = {}
    for r in frame.orderBy("job_id", "point_no").collect():
        found.setdefault(r["job_id"], []).append((r["chars_per_min"], r["eta_seconds"]))
    assert found == expected


def test_speed_of_sparse_points(spark):
    rows = [(1, "a", "k", "ok", None, 1.0, n, t) for n, t in ((10, 0), (20, 100), (30, 200), (40, 900), (0, 1000))]
    frame = telemetry.speed_series(log(spark, rows), spark.createDataFrame([(1, 1000)], "job_id long, total_chars long"))
    found = [(r["chars_per_min"], r["eta_seconds"]) for r in frame.orderBy("point_no").collect()]
    assert found == model_speed([(0, 10), (100, 30), (200, 60), (900, 100), (1000, 100)], 1000)


def test_recent(spark):
    parts = spark.createDataFrame([(i, i % 2, DAY + dt.timedelta(seconds=i // 3)) for i in range(20)], "part_id long, job_id long, finished_at timestamp")
    found = [(r["job_id"], r["part_id"]) for r in telemetry.recent(parts, 2).orderBy("job_id", "position").collect()]
    assert found == [(0, 18), (0, 16), (1, 19), (1, 17)]


def test_status_words(spark):
    schema = "keys array<struct<dead:boolean,cooldown_until:double,kind:string>>, disabled boolean, cooling double, busy int"
    rows = [([(False, 0.0, "")], True, 0.0, 0), ([(False, 70.0, "quota"), (True, 0.0, "auth")], False, 0.0, 0), ([(False, 0.0, "")], False, 15.0, 1), ([(False, 0.0, "")], False, 0.0, 1), ([(False, 0.0, "")], False, 0.0, 0)]
    frame = spark.createDataFrame(rows, schema).coalesce(1)
    said = [r["s"] for r in frame.select(telemetry.provider_status(F.col("keys"), F.col("disabled"), F.col("cooling"), F.col("busy"), F.lit(10.0)).alias("s")).collect()]
    assert said == ["disabled", "all keys out of quota (retry in 1m 0s)", "cooling down (5s)", "working", "idle"]


def test_log_tail(spark):
    lines = spark.range(30).select(F.col("id").alias("line_no"), F.lit("x").alias("line"))
    assert telemetry.log_tail(lines, 20, 15).count() == 15 and telemetry.log_tail(lines, 40, 15).count() == 30


def test_job_progress(spark):
    jobs = spark.createDataFrame([(1, "running"), (2, "done"), (3, "error")], "job_id int, status string")
    segments = spark.createDataFrame([(1, 0, 30), (1, 1, 10)], "job_id int, seg_id int, n_chars int")
    done = spark.createDataFrame([(1, 0), (1, 0)], "job_id int, seg_id int")
    found = {r["job_id"]: (r["done_segments"], r["percent"]) for r in telemetry.job_progress(jobs, segments, done).collect()}
    assert found == {1: (1, 75.0), 2: (0, 100.0), 3: (0, 0.0)}
