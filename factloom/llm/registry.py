"""Queries and SQL of the corpus operators, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, language, media, packing, pii, quality, secrets, sentencepiece, simhash, suffix_dedup

_MODULES = (packing, exact_dedup, simhash, language, media, quality, secrets, sentencepiece, pii, suffix_dedup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
