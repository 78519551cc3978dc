"""Scans that check what they read."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaFault(ValueError):
    """A table isn't what was agreed."""


def _header(spark: SparkSession, path: str) -> list[str]:
    names = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path).columns
    if names:
        names[0] = names[0].lstrip("﻿")
    return names


def csv_exact(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV whose header is ``columns`` in this order; all text; ragged rows fail the read."""
    found = _header(spark, path)
    if found != list(columns):
        raise SchemaFault(f"{path}: header {found}, expected {list(columns)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"')
    return reader.csv(path)


def csv_any(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """CSV with any header that names no column twice and holds the required ones; all text."""
    raw = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path).first()
    names = [str(x or "").lstrip("﻿") for x in raw] if raw else []
    if len(set(names)) < len(names):
        raise SchemaFault(f"{path}: a column name occurs twice")
    if lacking := sorted(set(required) - set(names)):
        raise SchemaFault(f"{path}: lacks {lacking}")
    return csv_exact(spark, path, names)


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object a line; blank lines are passed over, anything else fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str) -> dict[str, Any]:
    """A small JSON document, such as a contract or manifest."""
    return json.loads(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def at_path(document: dict[str, Any], path: str) -> Any:
    """What stands at a dotted path; None if nothing does."""
    here: Any = document
    for name in path.split("."):
        if not isinstance(here, dict) or name not in here:
            return None
        here = here[name]
    return here


def unmet(document: dict[str, Any], expected: dict[str, Any]) -> list[str]:
    """Dotted paths whose value isn't the expected one."""
    return [p for p, v in expected.items() if at_path(document, p) != v]


def files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, bytes, sha256) of the files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def bundle(digests: dict[str, str]) -> str:
    """Digest of the inputs by role."""
    import hashlib

    return hashlib.sha256("\0".join(sorted(f"{r}:{d}" for r, d in digests.items())).encode()).hexdigest()


def pinned(spark: SparkSession, path: str, df: DataFrame, sha256: str | None = None, size: int | None = None, rows: int | None = None, required: Sequence[str] = ()) -> DataFrame:
    """df, if the file at path has the digest and size, and the table the rows and columns, that were agreed."""
    faults = []
    if sha256 or size is not None:
        seen = files(spark, path).first()
        if sha256 and seen["sha256"] != sha256.lower():
            faults.append("digest")
        if size is not None and seen["bytes"] != size:
            faults.append("size")
    if rows is not None and df.count() != rows:
        faults.append("number of rows")
    if lacking := set(required) - set(df.columns):
        faults.append(f"columns {sorted(lacking)}")
    if faults:
        raise SchemaFault(f"{path}: {', '.join(faults)} differ from the pin")
    return df


def batch_faults(batches: DataFrame, master: DataFrame, key: str, batch: str, ordinal: str) -> DataFrame:
    """Rows (key, fault): what keeps batches from giving each row of the master once, in its order.

    batches: key, batch number, ordinal in the batch; master: key, ordinal (consecutive numbers).
    """
    placed = batches.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct(batch, ordinal)).alias("at"))
    both = master.select(key, F.col(ordinal).alias("master_at")).join(placed, key, "full")
    fault = F.when(F.col("master_at").isNull(), "not in master").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    plain = both.select(key, fault.alias("fault")).filter("fault is not null")
    # each row must follow, in the batches, the one before it in the master
    once = both.filter("master_at is not null and n = 1")
    before = once.select((F.col("master_at") + 1).alias("master_at"), F.col("at").alias("before"))
    return plain.unionByName(once.join(before, "master_at").filter("before > at").select(key, F.lit("out of order").alias("fault")))


def xml_records(spark: SparkSession, path: str, tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Elements of one kind from XML files."""
    reader = spark.read.format("xml").option("rowTag", tag)
    return (reader.schema(schema) if schema else reader).load(path)


def xml_fragments_of(text: str, tags: Sequence[str]) -> list[str]:
    """Elements of some kinds in one document's text, each as text of its own; elements of these kinds don't nest."""
    names = "|".join(re.escape(t) for t in tags)
    return [m[0] for m in re.finditer(rf"<({names})(?:\s[^>]*)?>.*?</\1\s*>", text, re.S)]


def redacted(df: DataFrame, column: str, secret: Sequence[str]) -> DataFrame:
    """A map column with the values of secret keys replaced, whatever their case."""
    names = [s.lower() for s in secret]
    return df.withColumn(column, F.transform_values(column, lambda k, v: F.when(F.lower(k).isin(*names) & (F.coalesce(v, F.lit("")) != ""), F.lit("<present:redacted>")).otherwise(v)))
