"""The queries of this subpackage, by name: each takes the session and a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafstream.llm import encoding, lookalike, mixing, oversized, packing, pairs, personal, surrogates
from leafstream.llm.tokens import token_sizes
from leafstream.sources.tables import table


#: Of these queries, whose data are invented; a run has a secret of its own.
KEY = "invented"


def _tables(spark: SparkSession, directory: str, *names: str) -> list[DataFrame]:
    return [table(spark, directory, n) for n in names]


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return oversized.oversized_found(*_tables(spark, directory, "chunks", "jobs", "dispatch_settings"))


def p1_pieces(spark: SparkSession, directory: str) -> DataFrame:
    return oversized.split_oversized(*_tables(spark, directory, "chunks", "jobs", "dispatch_settings"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return pairs.defects_found(table(spark, directory, "recent_parts"))


def p2_labels(spark: SparkSession, directory: str) -> DataFrame:
    return pairs.label_pairs(table(spark, directory, "recent_parts"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return encoding.damaged_found(table(spark, directory, "chunks"))


def p3_repaired(spark: SparkSession, directory: str) -> DataFrame:
    return encoding.repair_elements(table(spark, directory, "chunks"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return lookalike.alike_found(*_tables(spark, directory, "recent_parts", "chunks"))


def p4_consistent(spark: SparkSession, directory: str) -> DataFrame:
    return lookalike.consistent(*_tables(spark, directory, "recent_parts", "chunks"))


def p4_classes(spark: SparkSession, directory: str) -> DataFrame:
    return lookalike.alike_classes(*_tables(spark, directory, "recent_parts", "chunks"))


def p5_packed(spark: SparkSession, directory: str) -> DataFrame:
    documents, sizes = _tables(spark, directory, "documents", "container_sizes")
    return packing.pack(token_sizes(documents), sizes)


def p5_report(spark: SparkSession, directory: str) -> DataFrame:
    documents, sizes = _tables(spark, directory, "documents", "container_sizes")
    return packing.report(packing.pack(token_sizes(documents), sizes))


def p6_mixed(spark: SparkSession, directory: str) -> DataFrame:
    documents, targets = _tables(spark, directory, "documents", "mix_targets")
    return mixing.select(token_sizes(documents), targets)


def p6_shares(spark: SparkSession, directory: str) -> DataFrame:
    documents, targets = _tables(spark, directory, "documents", "mix_targets")
    return mixing.shares(token_sizes(documents), targets)


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return personal.personal_found(table(spark, directory, "documents"))


def p7_pseudonymized(spark: SparkSession, directory: str) -> DataFrame:
    return surrogates.pseudonymize(table(spark, directory, "documents"), KEY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_labels": p2_labels,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p4_found": p4_found,
    "p4_consistent": p4_consistent,
    "p4_classes": p4_classes,
    "p5_packed": p5_packed,
    "p5_report": p5_report,
    "p6_mixed": p6_mixed,
    "p6_shares": p6_shares,
    "p7_found": p7_found,
    "p7_pseudonymized": p7_pseudonymized,
}
