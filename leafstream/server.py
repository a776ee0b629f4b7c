"""Jobs over HTTP: start one with a text or a file, watch it, add services, stop it, fetch what came out.

    GET  /                         a page to do the same by hand
    GET  /api/jobs/ID              state, counts, speed, time left, services, last parts
    GET  /api/jobs/ID/text         the result, if it is text
    GET  /api/jobs/ID/download     the result
    POST /api/jobs                 {text | filename, file_b64; providers, mode, chunk_chars, ...}
    POST /api/jobs/ID/providers    {providers}
    POST /api/jobs/ID/cancel
    POST /api/test-provider        {provider}
    POST /api/models               {provider}

Settings of the environment: LEAFSTREAM_PASSWORD, which requests then need in the header X-Password;
LEAFSTREAM_HOST and LEAFSTREAM_PORT; LEAFSTREAM_DATA, a folder that keeps finished segments between runs.
``python -m leafstream.server`` serves.
"""

from __future__ import annotations

import hmac
import json
import os
import re
import threading
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leafstream.functions import progress as figures
from leafstream.functions import prompts
from leafstream.functions import providers as P
from leafstream.job import Job
from leafstream.operators import services
from leafstream.operators.dispatch import Call, Key, Provider, ServiceError, Settings
from leafstream.sources import files as sources

TEXTS = (".txt", ".md", ".srt")


def provider_of(entry: dict) -> Provider:
    """A provider from a request's entry; raises ValueError where its URL or model is missing."""
    name = str(entry.get("name") or "").strip() or "provider"
    url, model = (str(entry.get(a) or entry.get(b) or "").strip() for a, b in (("base_url", "url"), ("model", "model")))
    if not url or not model:
        raise ValueError(f"{name}: no {'URL' if not url else 'model'}")
    raw = str(entry.get("api_key") or entry.get("key") or "")
    keys = list(dict.fromkeys(k for k in raw.replace(",", " ").replace(";", " ").split() if k))
    return Provider(name, url, model, max(1, int(entry.get("concurrency") or 1)), [Key(k) for k in keys] or [Key("")], dict(entry.get("extra_headers") or {}))


def for_mode(entries: list[dict], mode: str) -> list[Provider]:
    """The enabled providers of a mode's role; raises ValueError for none, or for two of one name."""
    role = "review" if mode in ("refine", "review") else "translate"

    def has_role(entry: dict) -> bool:
        told = entry.get("use_for", entry.get("roles"))
        words = re.split(r"[,;/+\s]+", told) if isinstance(told, str) else list(told or [])
        named = {P.ROLE_NAMES.get(str(w).strip().lower()) for w in words} - {None}
        return not named or "both" in named or role in named

    found = [provider_of(e) for e in entries if e.get("enabled", True) and has_role(e)]
    if not found:
        raise ValueError(f"no provider is for {role}")
    if len({p.name for p in found}) < len(found):
        raise ValueError("two providers have one name")
    return found


def settings_of(body: dict) -> Settings:
    """A request's settings, within the limits set for requests."""
    mode = "refine" if body.get("mode") in ("refine", "review") else "translate"
    return Settings(
        int(body.get("chunk_chars") or 2500),
        int(body.get("max_attempts") or 6),
        float(body.get("temperature", 0.3)),
        float(body.get("timeout") or 240),
        str(body.get("instructions") or ""),
        bool(body.get("persian_digits")),
        wait_for_api=bool(body.get("wait_for_api", True)),
        mode=mode,
    ).clamped()


class Jobs:
    """The jobs of a server, each in a thread of its own that drives Spark."""

    def __init__(self, spark: SparkSession, call: Call, checkpoint: str | None = None):
        self.spark, self.call, self.checkpoint = spark, call, checkpoint
        self.jobs: dict[str, Job] = {}
        self.added: dict[str, list[Provider]] = {}
        self.lines: dict[str, list[str]] = {}
        self.results: dict[str, tuple[str, bytes]] = {}
        self.threads: dict[str, threading.Thread] = {}

    def start(self, body: dict) -> str:
        settings = settings_of(body)
        providers = for_mode(body.get("providers") or [], settings.mode)
        if body.get("file_b64"):
            files = sources.uploaded(self.spark, str(body.get("filename") or "file"), body["file_b64"])
        else:
            files = sources.pasted(self.spark, str(body.get("text") or ""))
        if files.where(F.col("ext").isNull()).count():
            raise ValueError(f"the format is none of {', '.join(sources.OUTPUTS)}")
        number = uuid.uuid4().hex[:12]
        self.added[number], self.lines[number] = [], []

        def more() -> list[Provider]:
            new, self.added[number] = self.added[number], []
            return new

        job = Job(files, providers, self.call, settings, self.checkpoint, more_providers=more, log=self.lines[number].append, watched=True)
        self.jobs[number] = job
        self.threads[number] = threading.Thread(target=self._run, args=(number, job), daemon=True)
        self.threads[number].start()
        return number

    def _run(self, number: str, job: Job) -> None:
        try:
            row = job.run().first()
            if row:
                self.results[number] = row["output"], bytes(row["content"])
            elif problem := job.problems().first():
                raise ValueError(problem["problem"])
            job.close()
        except Exception as e:  # noqa: BLE001
            job.state, job.error = "error", f"{type(e).__name__}: {e}"[:500]
            self.lines[number].append(job.error)

    def state(self, number: str, since: int = 0) -> dict:
        """A job's figures at this moment; those that take time are the waves' own, so that asking costs nothing."""
        told, lines = self.jobs[number].progress(), self.lines[number]
        left = told.get("eta_seconds")
        return told | {
            "left": None if left is None else figures.words(left),
            "log": lines[since:][-1500:],
            "log_size": len(lines),
            "output": self.results.get(number, (None,))[0],
        }


PAGE = """<!doctype html><meta charset="utf-8"><title>leafstream</title>
<style>body{font-family:sans-serif;max-width:50em;margin:2em auto}textarea{width:100%}pre{white-space:pre-wrap}</style>
<h1>leafstream</h1>
<p>Services (JSON list)<br><textarea id="services" rows="5">[{"name": "a", "base_url": "https://", "api_key": "", "model": ""}]</textarea>
<p>Text<br><textarea id="text" rows="8"></textarea><p>or a file <input type="file" id="file">
<p><select id="mode"><option>translate<option>refine</select> password <input id="password" type="password">
<button id="start">Start</button> <button id="add">Add services</button> <button id="stop">Stop</button> <a id="out"></a>
<p><progress id="bar" max="100" value="0"></progress> <span id="told"></span><pre id="log"></pre>
<script>
let job = null, since = 0;
const at = id => document.getElementById(id);
async function ask(path, body) {
  const r = await fetch(path, {method: body ? "POST" : "GET", body: body && JSON.stringify(body), headers: {"X-Password": at("password").value}});
  const told = await r.json();
  if (told.error) at("told").textContent = told.error;
  return told;
}
const services = () => JSON.parse(at("services").value);
at("start").onclick = async () => {
  const body = {providers: services(), mode: at("mode").value, text: at("text").value}, file = at("file").files[0];
  if (file) {
    body.filename = file.name;
    body.file_b64 = await new Promise(done => { const r = new FileReader(); r.onload = () => done(r.result.split(",")[1]); r.readAsDataURL(file); });
  }
  job = (await ask("/api/jobs", body)).id; since = 0; at("log").textContent = "";
};
at("add").onclick = () => ask(`/api/jobs/${job}/providers`, {providers: services()});
at("stop").onclick = () => ask(`/api/jobs/${job}/cancel`, {});
setInterval(async () => {
  if (!job) return;
  const t = await ask(`/api/jobs/${job}?since=${since}`);
  at("bar").value = t.percent; since = t.log_size;
  at("told").textContent = `${t.status} ${t.percent} % ${t.left ? t.left + " left" : ""} ${t.reason || ""}`;
  at("log").textContent += t.log.map(l => l + "\n").join("");
  if (t.output && !at("out").textContent) {
    const r = await fetch(`/api/jobs/${job}/download`, {headers: {"X-Password": at("password").value}});
    at("out").href = URL.createObjectURL(await r.blob()); at("out").download = at("out").textContent = t.output;
  }
}, 2000);
</script>"""


def handler(jobs: Jobs, password: str = "") -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _send(self, status: int, body: bytes, kind: str = "application/json", name: str | None = None) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            if name:
                self.send_header("Content-Disposition", f"attachment; filename*=UTF-8''{_quoted(name)}")
            self.end_headers()
            self.wfile.write(body)

        def _answer(self, act: Callable[[], dict]) -> None:
            if password and not hmac.compare_digest(self.headers.get("X-Password", ""), password):
                return self._send(401, b'{"error": "wrong password"}')
            try:
                status, told = 200, act()
            except KeyError:
                status, told = 404, {"error": "not found"}
            except (ValueError, TypeError) as e:
                status, told = 400, {"error": str(e)}
            except ServiceError as e:
                status, told = 200, {"ok": False, "kind": e.kind, "error": str(e)}
            if told is not None:
                self._send(status, json.dumps(told, ensure_ascii=False).encode())

        def do_GET(self) -> None:
            path, _, query = self.path.partition("?")
            if path == "/":
                return self._send(200, PAGE.encode(), "text/html; charset=utf-8")
            parts = path.strip("/").split("/")

            def act() -> dict | None:
                if len(parts) not in (3, 4) or parts[:2] != ["api", "jobs"]:
                    raise KeyError(path)
                if len(parts) == 3:
                    since = query.removeprefix("since=")
                    return jobs.state(parts[2], int(since) if since.isdigit() else 0)
                name, content = jobs.results[parts[2]]
                if parts[3] == "download":
                    self._send(200, content, "application/octet-stream", name)
                    return None
                if parts[3] != "text" or not name.endswith(TEXTS):
                    raise KeyError(path)
                return {"text": content.decode()}

            self._answer(act)

        def do_POST(self) -> None:
            parts = self.path.strip("/").split("/")

            def act() -> dict:
                size = int(self.headers.get("Content-Length") or 0)
                if size > sources.UPLOAD_LIMIT * 4 // 3 + 65536:
                    raise ValueError("the request is too large")
                body = json.loads(self.rfile.read(size) or b"{}")
                if parts == ["api", "jobs"]:
                    return {"id": jobs.start(body)}
                if parts[:2] == ["api", "jobs"] and len(parts) == 4 and parts[3] == "providers":
                    job = jobs.jobs[parts[2]]
                    new = for_mode(body.get("providers") or [], job.settings.mode)
                    jobs.added[parts[2]] += new
                    return {"added": [p.name for p in new]}
                if parts[:2] == ["api", "jobs"] and len(parts) == 4 and parts[3] == "cancel":
                    jobs.jobs[parts[2]].cancel()
                    return {"ok": True}
                if parts in (["api", "test-provider"], ["api", "models"]):
                    p = provider_of(body.get("provider") or body)
                    service = {"name": p.name, "base_url": p.base_url, "model": p.model, "extra_headers": p.extra_headers}
                    if parts[1] == "models":
                        return {"models": services.models(service, p.keys[0].value)}
                    return {"ok": True, "keys": [{"answer": jobs.call(service, k.value, "Hello.", Settings(timeout_s=60.0))} for k in p.keys]}
                raise KeyError(self.path)

            self._answer(act)

    return Handler


def _quoted(name: str) -> str:
    from urllib.parse import quote

    return quote(name)


def serve(spark: SparkSession, call: Call, host: str = "127.0.0.1", port: int = 8000, checkpoint: str | None = None) -> ThreadingHTTPServer:
    """A server, not yet running; ``serve_forever()`` runs it."""
    return ThreadingHTTPServer((host, port), handler(Jobs(spark, call, checkpoint), os.environ.get("LEAFSTREAM_PASSWORD", "")))


class ByMode:
    """Calls with the built-in prompt of each run's mode."""

    def __call__(self, service: dict, key: str, prompt: str, settings: Settings) -> str:
        return services.HttpCall(prompts.BASE[settings.mode])(service, key, prompt, settings)


def from_environment(spark: SparkSession) -> ThreadingHTTPServer:
    """A server as the environment says; the next free port where the one named is taken."""
    env = os.environ.get
    host, port = env("LEAFSTREAM_HOST", "127.0.0.1"), int(env("LEAFSTREAM_PORT", "8000"))
    for candidate in range(port, port + 50):
        try:
            return serve(spark, ByMode(), host, candidate, env("LEAFSTREAM_DATA"))
        except OSError:
            continue
    raise OSError(f"no free port from {port} on")


def self_test(spark: SparkSession) -> str:
    """A small job with a stand-in for a service: what comes out of it."""
    jobs = Jobs(spark, services.Echo())
    number = jobs.start({"text": "One text.\n\nAnother text.", "providers": [{"name": "a", "url": "http://none", "model": "m"}]})
    jobs.threads[number].join()
    return jobs.results[number][1].decode() if number in jobs.results else jobs.jobs[number].error


def main() -> None:
    spark = SparkSession.builder.appName("leafstream").getOrCreate()
    running = from_environment(spark)
    print(f"http://{running.server_address[0]}:{running.server_port}")
    running.serve_forever()


if __name__ == "__main__":
    main()
