"""Queries of the training-data operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataq.common import table
from strataq.llm.containers import fill_containers, fill_report
from strataq.llm.garbling import find_garbled
from strataq.llm.handwritten import judged
from strataq.llm.mixing import mix, shares
from strataq.llm.pairs import documented, pairs


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return judged(table(spark, d, "source_files")).select("file_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return judged(table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return documented(table(spark, d, "source_files"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs(table(spark, d, "source_files"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(table(spark, d, "documents"), table(spark, d, "container_kinds"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p6_containers(spark, d), table(spark, d, "container_kinds"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(p7_mix(spark, d), table(spark, d, "mix_targets"))


def p7_mix_balanced(spark: SparkSession, d: str) -> DataFrame:
    """The largest mix in which every source reaches its weight."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), shortfall=0.0)


def p7_shares_balanced(spark: SparkSession, d: str) -> DataFrame:
    return shares(p7_mix_balanced(spark, d), table(spark, d, "mix_targets"))


def p7_mix_of_all(spark: SparkSession, d: str) -> DataFrame:
    """The mix as large as all targeted texts together: small sources repeat up to their caps and fall short."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), total_tokens="all")


def p7_shares_of_all(spark: SparkSession, d: str) -> DataFrame:
    return shares(p7_mix_of_all(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "documents"), with_text=True)


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p5_found, p5_pairs, p6_containers, p6_report, p7_mix, p7_shares, p7_mix_balanced, p7_shares_balanced, p7_mix_of_all, p7_shares_of_all, p8_found, p8_restored)}
SQL: dict[str, str] = {}
