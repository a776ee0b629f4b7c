"""``python -m leafstream.cli FILES -p providers.json``: renders a file or a folder of files.

Exits with 0 when all is done, 1 if nothing came out, 2 if it stopped before the end, 130 if interrupted.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstream.functions import prompts
from leafstream.job import Job
from leafstream.operators import providers as pools
from leafstream.operators.dispatch import Key, Provider, Settings
from leafstream.operators.services import HttpCall
from leafstream.sources import files as sources


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafstream", description=__doc__)
    p.add_argument("input", help="a file, or a folder of files")
    p.add_argument("-p", "--providers", required=True, help="JSON file of services; changes to it are taken in while the job runs")
    p.add_argument("-o", "--output", default=".", help="folder for the results, or a file's name for a single one")
    p.add_argument("--prompt", help="file with a system prompt of your own")
    p.add_argument("--checkpoint", help="folder that keeps finished segments between runs")
    p.add_argument("--chunk-chars", type=int, default=2500)
    p.add_argument("--temperature", type=float, default=0.3)
    p.add_argument("--timeout", type=float, default=240.0)
    p.add_argument("--max-attempts", type=int, default=6)
    p.add_argument("--instructions", default="")
    p.add_argument("--persian-digits", action="store_true")
    p.add_argument("--no-resume", action="store_true", help="take nothing from the checkpoint, and keep nothing in it")
    p.add_argument("--refine", action="store_true", help="polish texts that are rendered already")
    p.add_argument("--no-wait", action="store_true", help="stop, rather than wait, when no service can be used")
    return p


def services(spark: SparkSession, path: str, mode: str, log: Callable[[str], None] = lambda line: None) -> list[Provider]:
    """The providers of a file that can be used in a mode, the others named in the log; raises ValueError if there are
    none, or one has a problem."""
    rows = pools.configured(sources.read_providers(spark, path))
    bad = [f"{r['name']}: {r['problem']}" for r in rows.where("problem IS NOT NULL").collect()]
    if bad:
        raise ValueError("; ".join(bad))
    for r in pools.skipped(rows, F.lit(mode)).collect():
        log(f"left out: {r['note']}")
    found = [
        Provider(r["name"], r["base_url"], r["model"], r["concurrency"], [Key(k) for k in r["keys"]] or [Key("")], dict(r["extra_headers"]))
        for r in pools.used_for(rows, F.lit(mode)).collect()
    ]
    if not found:
        raise ValueError(f"no provider is for {'review' if mode == 'refine' else 'translate'}")
    return found


def watch(path: str, read: Callable[[], list[Provider]], log: Callable[[str], None]) -> Callable[[], list[Provider]]:
    """A providers file's entries when the file has changed since it was last looked at; one that can't be read is
    left for its next change."""
    seen = [os.path.getmtime(path)]

    def more() -> list[Provider]:
        try:
            now = os.path.getmtime(path)
            if now == seen[0]:
                return []
            seen[0] = now
            return read()
        except (OSError, ValueError) as e:
            log(f"{path}: {e}")
            return []

    return more


def deliver(built: DataFrame, output: str) -> int:
    """Writes the built files, one at a time: into a folder, or a single one under the name given."""
    named = bool(Path(output).suffix) and not Path(output).is_dir() and built.count() == 1
    (Path(output).parent if named else Path(output)).mkdir(parents=True, exist_ok=True)
    written = 0
    for row in built.toLocalIterator():
        (Path(output) if named else Path(output) / row["output"]).write_bytes(row["content"])
        written += 1
    return written


def summary(job: Job) -> list[str]:
    """The end of a run in lines: the whole, each service, each file that could not be read."""
    told = job.progress()
    lines = [f"{told['status']}: {told['done_segments']} of {told['total_segments']} segments, {told['failed_segments']} given up, {told['percent']} %"]
    for p in told.get("providers", ()):
        state = f"switched off: {p['reason']}" if p["disabled"] else f"{p['avg_seconds'] or 0} s a chunk"
        lines.append(f"{p['name']}: {p['done']} chunks, {p['failed']} errors, {p['keys_total'] - p['keys_dead']} of {p['keys_total']} keys, {state}")
    lines += [f"{r['doc_id']}: {r['problem']}" for r in job.problems().toLocalIterator()]
    return lines


def main(arguments: list[str] | None = None, call=None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("leafstream").getOrCreate()
    mode = "refine" if a.refine else "translate"
    settings = Settings(a.chunk_chars, a.max_attempts, a.temperature, a.timeout, a.instructions, a.persian_digits, wait_for_api=not a.no_wait, mode=mode)
    read = lambda: services(spark, a.providers, mode, print)
    try:
        providers = read()
    except ValueError as e:
        print(e)
        return 1
    prompt = Path(a.prompt).read_text(encoding="utf-8") if a.prompt else prompts.BASE[mode]
    kept = None if a.no_resume else a.checkpoint
    job = Job(sources.read_files(spark, a.input), providers, call or HttpCall(prompt), settings.clamped(), kept, more_providers=watch(a.providers, read, print), log=print)
    try:
        built = job.run()
    except KeyboardInterrupt:
        job.cancel()
        return 130
    written = deliver(built, a.output)
    print("\n".join(summary(job)))
    job.close()
    return 1 if not written else 0 if job.state == "done" else 2


if __name__ == "__main__":
    sys.exit(main())
