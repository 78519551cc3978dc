"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, idfiles, line_dedup, lm, packing, pieces, quality_rules, simhash, topk, url_rules

_MODULES = (packing, pieces, lm, line_dedup, html_text, idfiles, quality_rules, simhash, topk, url_rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in vars(m).items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
