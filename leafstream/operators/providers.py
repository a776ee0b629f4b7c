"""Tables of providers: reading their dirt, choosing by role, and merging changes while a job runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstream.functions.providers import chat_url, key_label, mode_role, parse_roles, parse_roles_text, role_label, split_keys
from leafstream.functions.text import strip

COLUMNS = ["name", "base_url", "api_key", "model", "concurrency", "enabled", "extra_headers", "use_for"]


def configured(raw: DataFrame) -> DataFrame:
    """Providers with defaults in place of what is missing: (name, base_url, keys, model, concurrency, enabled,
    extra_headers, roles, problem).

    A null or blank name is "provider", concurrency is at least 1, a null `enabled` is true, and no roles are both.
    Roles may be an array of names or a text of them.
    `problem` says why a provider can't be used: no URL, no model, or a name that another one has.
    """
    roles = parse_roles_text if raw.schema["use_for"].dataType.typeName() == "string" else parse_roles
    trimmed = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    name = F.when(trimmed("name") == "", "provider").otherwise(trimmed("name"))
    rows = raw.select(
        name.alias("name"),
        trimmed("base_url").alias("base_url"),
        split_keys(F.col("api_key")).alias("keys"),
        trimmed("model").alias("model"),
        F.greatest(F.lit(1), F.coalesce("concurrency", F.lit(1))).alias("concurrency"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.coalesce("extra_headers", F.create_map().cast("map<string,string>")).alias("extra_headers"),
        roles(F.col("use_for")).alias("roles"),
    )
    named = F.count(F.lit(1)).over(Window.partitionBy("name"))
    problem = (
        F.when(F.col("base_url") == "", "no URL").when(F.col("model") == "", "no model").when(named > 1, "name is not unique")
    )
    return rows.withColumn("problem", problem)


def used_for(providers: DataFrame, mode: Column) -> DataFrame:
    """The enabled, usable providers of a mode's role."""
    return providers.where("enabled AND problem IS NULL").where(F.array_contains("roles", mode_role(mode)))


def skipped(providers: DataFrame, mode: Column) -> DataFrame:
    """(name, note) of the enabled providers that a mode has no use for."""
    role = mode_role(mode)
    rest = providers.where("enabled AND problem IS NULL").where(~F.array_contains("roles", role))
    note = F.concat(F.col("name"), F.lit(": for "), role_label(F.col("roles")))
    return rest.select("name", note.alias("note"))


def endpoints(providers: DataFrame) -> DataFrame:
    """(name, url, key_no, key_label, concurrency): one row for each key, and one for a provider without any."""
    rows = providers.select("name", chat_url(F.col("base_url")).alias("url"), "concurrency", F.posexplode_outer("keys").alias("key_no", "key"))
    return rows.select("name", "url", F.coalesce("key_no", F.lit(0)).alias("key_no"), key_label(F.col("key")).alias("key_label"), "concurrency")


def upsert(running: DataFrame, changes: DataFrame) -> DataFrame:
    """`running` after enabled `changes`, by name: (name, base_url, keys, model, concurrency, disabled, revived,
    added_keys, is_new).

    A known provider gets the keys it lacks and the greater concurrency. Model and URL change only where it was
    disabled, which also brings it back; new keys bring it back where all its keys had failed. Of several changes
    to one name the first in (model, URL) order holds.
    """
    wanted = changes.where("enabled AND problem IS NULL").groupBy("name").agg(
        F.min(F.struct("model", "base_url", "keys", "concurrency")).alias("c")
    )
    rows = running.join(wanted, "name", "full_outer")
    known = F.col("keys").isNotNull()
    more = F.array_except(F.coalesce("c.keys", F.array().cast("array<string>")), F.coalesce("keys", F.array().cast("array<string>")))
    fixed = F.coalesce(F.col("disabled") & ((F.col("c.model") != F.col("model")) | (F.col("c.base_url") != F.col("base_url"))), F.lit(False))
    refilled = F.coalesce(F.col("disabled") & F.startswith("disabled_reason", F.lit("all keys")) & (F.size(more) > 0), F.lit(False))
    pick = lambda own: F.when(known & ~fixed, F.col(own)).otherwise(F.coalesce(F.col(f"c.{own}"), F.col(own)))
    return rows.select(
        "name",
        pick("base_url").alias("base_url"),
        F.when(known, F.concat("keys", more)).otherwise(F.col("c.keys")).alias("keys"),
        pick("model").alias("model"),
        F.greatest("concurrency", "c.concurrency").alias("concurrency"),
        (F.coalesce("disabled", F.lit(False)) & ~fixed & ~refilled).alias("disabled"),
        (fixed | refilled).alias("revived"),
        F.size(more).alias("added_keys"),
        (~known).alias("is_new"),
    )


def upsert_waiting(waiting: DataFrame, changes: DataFrame) -> DataFrame:
    """The providers of a job that hasn't begun, after `changes`: keys join those of the same name, others are added."""
    wanted = changes.where("enabled AND problem IS NULL").groupBy("name").agg(
        F.min(F.struct("model", "base_url", "keys", "concurrency")).alias("c")
    )
    rows = waiting.join(wanted, "name", "full_outer")
    none = F.array().cast("array<string>")
    return rows.select(
        "name",
        F.coalesce("base_url", "c.base_url").alias("base_url"),
        F.array_distinct(F.concat(F.coalesce("keys", none), F.coalesce("c.keys", none))).alias("keys"),
        F.coalesce("model", "c.model").alias("model"),
        F.greatest("concurrency", "c.concurrency").alias("concurrency"),
    )


def totals(providers: DataFrame) -> DataFrame:
    """(workers, n_keys, models) of the enabled providers: requests at a time, keys, and the models, sorted and once each."""
    return providers.where("enabled").agg(
        F.sum("concurrency").alias("workers"), F.sum(F.size("keys")).alias("n_keys"), F.array_sort(F.collect_set("model")).alias("models")
    )


#: What settings are by default, and the least and greatest that requests may ask for.
LIMITS = {"max_chars": (2500, 300, 20000), "max_attempts": (6, 1, 30), "timeout_s": (240.0, 20.0, None)}


def clamped(settings: DataFrame) -> DataFrame:
    """Settings with defaults in place of nulls, within the limits of requests."""

    def held(name: str) -> Column:
        default, low, high = LIMITS[name]
        value = F.greatest(F.lit(low), F.coalesce(F.col(name), F.lit(default)))
        return value if high is None else F.least(F.lit(high), value)

    return settings.select(*[held(c).alias(c) if c in LIMITS else F.col(c) for c in settings.columns])
