from __future__ import annotations

import base64
import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from leafstream import server
from leafstream.operators.services import Echo

ENTRY = {"name": "a", "url": "http://h/v1", "model": "m", "key": "k1, k2;k1"}


@pytest.fixture
def ask(spark, monkeypatch):
    monkeypatch.setenv("LEAFSTREAM_PASSWORD", "pass")
    running = server.serve(spark, Echo(change=str.upper), port=0)
    threading.Thread(target=running.serve_forever, daemon=True).start()

    def ask(path, body=None, password="pass"):
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"http://127.0.0.1:{running.server_port}{path}", data, {"X-Password": password})
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                raw = r.read()
                return r.status, json.loads(raw) if r.headers["Content-Type"] == "application/json" else raw
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    yield ask
    running.shutdown()


def finished(ask, number):
    for _ in range(300):
        status, told = ask(f"/api/jobs/{number}")
        if told["status"] not in ("pending", "running") and (told["output"] or told["status"] != "done"):
            return told
        time.sleep(0.2)
    raise AssertionError("the job doesn't end")


def test_jobs(ask):
    status, told = ask("/api/jobs", {"text": "Hello.\n\nYou.", "providers": [ENTRY]})
    assert status == 200
    state = finished(ask, told["id"])
    assert state["status"] == "done" and state["output"] == "text.fa.txt" and state["log"]
    assert ask(f"/api/jobs/{told['id']}/text")[1] == {"text": "HELLO.\n\nYOU."}
    assert ask(f"/api/jobs/{told['id']}/download")[1] == b"HELLO.\n\nYOU."
    assert ask(f"/api/jobs/{told['id']}/providers", {"providers": [ENTRY | {"name": "b"}]})[1] == {"added": ["b"]}
    assert ask(f"/api/jobs/{told['id']}/cancel", {})[0] == 200
    encoded = base64.b64encode(b"x").decode()
    assert finished(ask, ask("/api/jobs", {"filename": "../b.md", "file_b64": encoded, "providers": [ENTRY]})[1]["id"])["output"] == "b.fa.txt"


@pytest.mark.parametrize(
    ("body", "status"),
    [({"text": " ", "providers": [ENTRY]}, 400), ({"text": "a", "providers": []}, 400), ({"text": "a", "providers": [ENTRY, ENTRY]}, 400), ({"text": "a", "providers": [{"name": "x"}]}, 400), ({"text": "a", "mode": "refine", "providers": [ENTRY | {"roles": "t"}]}, 400), ({"filename": "a.xyz", "file_b64": "YQ==", "providers": [ENTRY]}, 400)],
)
def test_refused(ask, body, status):
    assert ask("/api/jobs", body)[0] == status


def test_others(ask):
    assert ask("/api/jobs/none")[0] == 404 and ask("/elsewhere")[0] == 404
    assert ask("/api/jobs/none", password="wrong")[0] == 401
    assert ask("/api/test-provider", {"provider": ENTRY})[1]["keys"] == [{"answer": "HELLO."}] * 2


def test_settings():
    s = server.settings_of({"chunk_chars": 1, "max_attempts": 99, "timeout": 1, "mode": "review"})
    assert (s.max_chars, s.max_attempts, s.timeout_s, s.mode) == (300, 30, 20, "refine")


def test_progress_while_it_runs(spark):
    """Percent, time left and the services' lines change before the end; a page is there; a cancelled job stops."""

    class Slow:
        def __call__(self, service, key, prompt, settings):
            time.sleep(0.2)
            return prompt

    jobs = server.Jobs(spark, Slow())
    text = "\n\n".join(f"Paragraph {i} {'x' * 280}" for i in range(60))
    number = jobs.start({"text": text, "providers": [ENTRY], "chunk_chars": 300})
    seen = []
    while jobs.threads[number].is_alive():
        seen.append(jobs.state(number))
        time.sleep(0.2)
    middle = [t for t in seen if 0 < t["percent"] < 100]
    assert middle and middle[-1]["eta_seconds"] is not None and middle[-1]["left"] and middle[-1]["providers"][0]["done"] > 0
    assert middle[-1]["recent"][0]["translation"].startswith("Paragraph") and middle[-1]["chars_per_min"] > 0
    end = jobs.state(number)
    assert end["status"] == "done" and end["percent"] == 100 and jobs.results[number][1].decode() == text
    assert server.self_test(spark) == "One text.\n\nAnother text."


def test_page(ask):
    import re

    assert re.search(b"<title>leafstream", ask("/")[1])


def test_roles_in_words():
    assert [p.name for p in server.for_mode([ENTRY | {"use_for": "review"}, ENTRY | {"name": "b", "use_for": "t/r"}], "refine")] == ["a", "b"]
    with pytest.raises(ValueError):
        server.for_mode([ENTRY | {"use_for": "review"}], "translate")


def test_environment(spark, monkeypatch):
    monkeypatch.setenv("LEAFSTREAM_PORT", "0")
    assert server.from_environment(spark).server_port > 0
