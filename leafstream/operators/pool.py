"""What the driver knows of the services of a run: when each can be asked again, and what it has done.

One number says how a service or a key stands: the time from which it is open. It lies in the past for what can be
used, in the future for what rests, and is NEVER for what was rejected or switched off.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Row, SparkSession

from leafstream.functions import providers as P
from leafstream.operators import providers as tables

NEVER = math.inf


@dataclass
class Key:
    value: str
    open_at: float = 0.0
    kind: str = ""
    quota_hits: int = 0
    uses: int = 0


@dataclass
class Provider:
    """A service, its keys and its tally."""

    name: str
    base_url: str = ""
    model: str = ""
    concurrency: int = 1
    keys: list[Key] = field(default_factory=lambda: [Key("")])
    extra_headers: dict[str, str] = field(default_factory=dict)
    open_at: float = 0.0
    reason: str = ""
    errors: int = 0
    done: int = 0
    failed: int = 0
    chars: int = 0
    seconds: float = 0.0

    @property
    def disabled(self) -> bool:
        return self.open_at == NEVER

    def opens(self) -> float:
        """When the service can be asked: itself, with the key that is open first."""
        return max(self.open_at, min((k.open_at for k in self.keys), default=NEVER))

    def out_of_quota(self, now: float) -> bool:
        """Whether nothing but used-up quotas keeps all its keys from use."""
        kinds = {k.kind if k.open_at > now else "" for k in self.keys if k.open_at < NEVER}
        return kinds == {"quota"}

    def average(self) -> float | None:
        return self.seconds / self.done if self.done else None


@dataclass(frozen=True)
class Settings:
    max_chars: int = 2500
    max_attempts: int = 6
    temperature: float = 0.3
    timeout_s: float = 240.0
    extra_instructions: str = ""
    persian_digits: bool = False
    max_consecutive_errors: int = P.ERRORS_IN_A_ROW
    wait_for_api: bool = True
    mode: str = "translate"
    #: The time that a wave's slots take calls for, and the pause that a slot sits out by itself.
    wave_seconds: float = 60.0
    patience_s: float = 10.0

    def clamped(self) -> Settings:
        """Within the limits that requests from outside are held to."""
        held = {name: min(high or math.inf, max(low, getattr(self, name))) for name, (_, low, high) in tables.LIMITS.items()}
        return replace(self, **held)


def learn(providers: list[Provider], counted: list[Row], settings: Settings, now: float) -> None:
    """Takes in a wave's counts by provider and key (see ``dispatch.counted``): tallies, rejections, and pauses from `now`."""
    known = {p.name: p for p in providers}
    for r in sorted(counted, key=lambda r: (r["last_error"] or 0.0, r["key_no"])):
        p = known[r["provider"]]
        key = p.keys[r["key_no"]]
        key.uses += r["uses"]
        p.done, p.failed = p.done + r["done"], p.failed + r["errors"]
        p.chars, p.seconds = p.chars + (r["chars"] or 0), p.seconds + (r["seconds"] or 0.0)
        # what came after the last answer counts on, what came before it is over
        fresh = r["last_ok"] is None or r["last_error"] is not None and r["last_error"] > r["last_ok"]
        if r["last_ok"] is not None:
            p.errors, key.kind = 0, ""
        wait = r["retry_after"]
        if r["rate_limit"] or r["in_a_row"]:
            p.errors += (r["rate_limit"] + r["in_a_row"]) if r["last_ok"] is None else int(fresh)
        if r["rate_limit"]:
            key.kind, key.quota_hits = "rate_limit", 0
            key.open_at = max(key.open_at, now + P.rate_seconds(p.errors, wait)) if fresh else key.open_at
        if r["quota"]:
            key.kind, key.quota_hits = "quota", key.quota_hits + 1
            key.open_at = max(key.open_at, now + P.quota_seconds(key.quota_hits, wait))
        if r["auth"]:
            key.kind, key.open_at = "auth", NEVER
        if r["pausing"] and fresh:
            p.open_at = max(p.open_at, now + P.error_seconds(p.errors, settings.max_consecutive_errors))
        if r["fatal"]:
            p.open_at, p.reason = NEVER, r["fatal_error"] or "fatal error"
        if all(k.open_at == NEVER for k in p.keys) and not p.disabled:
            p.open_at, p.reason = NEVER, "all keys were rejected"


def join(spark: SparkSession, providers: list[Provider], changes: list[Provider]) -> list[str]:
    """Takes in providers or keys that came while the run goes on, by the rules of ``providers.upsert``; what changed,
    in words."""
    if not changes:
        return []
    held = [(p.name, p.base_url, [k.value for k in p.keys if k.value], p.model, p.concurrency, p.disabled, p.reason) for p in providers]
    running = spark.createDataFrame(
        held, "name string, base_url string, keys array<string>, model string, concurrency int, disabled boolean, disabled_reason string"
    )
    wanted = [(c.name, c.base_url, [k.value for k in c.keys if k.value], c.model, c.concurrency, True, None) for c in changes]
    new = spark.createDataFrame(
        wanted, "name string, base_url string, keys array<string>, model string, concurrency int, enabled boolean, problem string"
    )
    known = {p.name: p for p in providers}
    offered = {c.name: c for c in changes}
    notes = []
    for r in tables.upsert(running, new).orderBy("name").collect():  # a row for each provider
        name = r["name"]
        if r["is_new"]:
            p = offered[name]
            providers.append(p)
            notes.append(f"{name}: added, with {len(p.keys)} keys and {p.concurrency} requests at a time")
            continue
        p = known[name]
        changed = [f"{r['added_keys']} more keys"] * bool(r["added_keys"]) + [f"{r['concurrency']} requests at a time"] * (r["concurrency"] > p.concurrency)
        if (r["model"], r["base_url"]) != (p.model, p.base_url):
            changed.append("another model or URL")
            p.keys = [Key(k.value, uses=k.uses) for k in p.keys]
        own = {k.value: k for k in p.keys}
        p.keys = [own.get(v) or Key(v) for v in r["keys"]] or p.keys
        p.model, p.base_url, p.concurrency = r["model"], r["base_url"], r["concurrency"]
        if changed:
            p.errors = 0
            p.open_at = NEVER if r["disabled"] else 0.0
            p.reason = p.reason if r["disabled"] else ""
            notes.append(f"{name}: {', '.join(changed)}")
    return notes


def standing(p: Provider, now: float) -> dict:
    """A provider's line in a table of progress."""
    live = [k for k in p.keys if k.open_at < NEVER]
    return {
        "name": p.name,
        "model": p.model,
        "done": p.done,
        "failed": p.failed,
        "chars": p.chars,
        "avg_seconds": None if p.average() is None else round(p.average(), 1),
        "keys_total": len(p.keys),
        "keys_dead": len(p.keys) - len(live),
        "retry_in": max(0, int(p.opens() - now)) if p.opens() < NEVER else None,
        "disabled": p.disabled,
        "reason": p.reason,
        "keys": [{"label": P.label(k.value), "uses": k.uses, "kind": k.kind, "dead": k.open_at == NEVER} for k in p.keys],
    }
