"""Queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, fim, language_id, manifest, minhash, mixing, packing, pieces, quality, secrets, substrings, suffixes, token_output
from .common import ship


def _of(f: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": _of(mixing.op1_mix, "documents"),
        "op2_suffixes": _of(suffixes.op2_suffixes, "documents"),
        "op3_embeddings": _of(embeddings.op3_embeddings, "embeddings"),
        "op4_secrets": _of(secrets.op4_secrets, "documents"),
        "op5_minhash": _of(minhash.op5_minhash, "documents"),
        "op6_substrings": _of(substrings.op6_substrings, "documents"),
        "op7_token_output": _of(token_output.op7_token_output, "documents"),
        "op8_quality_rules": _of(quality.op8_quality_rules, "documents", "labels"),
        "op9_language_id": _of(language_id.op9_language_id, "documents"),
        "op10_pieces": _of(pieces.op10_pieces, "documents"),
        "op11_fim": _of(fim.op11_fim, "documents"),
        "op12_packing": _of(packing.op12_packing, "documents"),
        "op13_merkle_manifest": _of(manifest.op13_merkle_manifest, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffixes": suffixes.ORACLE_SQL, "op3_embeddings": embeddings.ORACLE_SQL, "op5_minhash": minhash.ORACLE_SQL, "op6_substrings": substrings.ORACLE_SQL,
        "op8_quality_rules": quality.ORACLE_SQL, "op11_fim": fim.ORACLE_SQL, "op13_merkle_manifest": manifest.ORACLE_SQL,
    }
