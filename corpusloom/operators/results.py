"""The shared shape of result rows: every count with its denominator and kind of response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import share

COLUMNS = ("section", "measure", "category", "count", "denominator", "percent", "value", "value_text", "unit", "denominator_definition", "response_type", "work_ids", "note")


def long_rows(df: DataFrame, section: str, measure: str, definition: str, response: str, **given: Column) -> DataFrame:
    """df (category, count, denominator and more) as result rows; columns that it lacks are null."""
    fixed = {"section": F.lit(section), "measure": F.lit(measure), "denominator_definition": F.lit(definition), "response_type": F.lit(response), "percent": share(F.col("count"), F.col("denominator"))}
    kinds = {"count": "long", "denominator": "long", "percent": "double", "value": "double"}
    source = fixed | given
    pick = lambda c: source[c] if c in source else F.col(c) if c in df.columns else F.lit(None)
    return df.select(*(pick(c).cast("array<string>" if c == "work_ids" else kinds.get(c, "string")).alias(c) for c in COLUMNS))
