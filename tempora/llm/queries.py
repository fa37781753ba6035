"""The queries of this package, one for each operator, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chats, decontaminate, langid, lm, near, quality, secrets, substrings, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": secrets.query,
    "op2_quality": quality.query,
    "op3_bpe": bpe.query,
    "op4_lm": lm.query,
    "op5_substrings": substrings.query,
    "op6_near": near.query,
    "op7_chats": chats.query,
    "op8_langid": langid.query,
    "op9_vectors": vectors.query,
    "op10_decontaminate": decontaminate.query,
}

ORACLES: dict[str, Callable[[], str]] = {
    "op1_secrets": secrets.oracle,
    "op7_chats": chats.oracle,
    "op9_vectors": vectors.oracle,
}


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLES.items()}
