"""Registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocation, decontam, erasure, fingerprint, langid, linedup, mainhtml, neardup, pieces, quality, secrets, sharding, toxicity
from .core import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenize(table(spark, sf_dir, "documents"))


def op4_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"))


def op11_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erasure.erasure(spark, {name: table(spark, sf_dir, name) for name in erasure.AMOUNTS})


def op12_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op13_mainhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.main_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_langid, op2_quality, op3_pieces, op4_linedup, op5_decontam, op6_secrets, op7_toxicity, op8_neardup, op9_fingerprint, op10_sharding, op11_erasure, op12_collocation, op13_mainhtml)}


def oracle_sql() -> dict[str, str]:
    return {"op4_linedup": linedup.ORACLE, "op5_decontam": decontam.ORACLE, "op8_neardup": neardup.ORACLE, "op10_sharding": sharding.ORACLE, "op12_collocation": collocation.ORACLE}
