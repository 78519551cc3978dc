"""Sinks, digests and packages."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..operators.lineage import cut
from ..operators.sampling import batches
from .tables import files


def flat_text(df: DataFrame) -> DataFrame:
    """All columns as text for CSV: null to empty, booleans to true and false, nested values to JSON."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        made = F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
        out.append(F.coalesce(made, F.lit("")).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; fails if the path exists."""
    flat_text(df).write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_pair(df: DataFrame, path: str, columns: Sequence[str] | None = None, key: Sequence[str] = ()) -> None:
    """A table as CSV and as JSON lines, both from rows that are computed once.

    columns: the names that it must have, in this order; key: columns that no two rows may share. A broken contract writes
    nothing.
    """
    if columns is not None and list(columns) != df.columns:
        raise ValueError(f"columns {df.columns} instead of {list(columns)}")
    df = cut(df)
    if key and (twice := df.groupBy(*key).count().filter("count > 1").first()):
        raise ValueError(f"key given twice: {twice}")
    write_csv(df, f"{path}.csv")
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{path}.json")


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the row's canonical JSON: keys sorted, values as text, nulls empty."""
    return F.sha2(F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(columns)))), 256)


def joined_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of trimmed values joined by a zero character."""
    return F.sha2(F.concat_ws("\0", *(strip(c) for c in columns)), 256)


def set_id(prefix: str, members: Column) -> Column:
    """Stable id of a set of ids."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(members)), "\0"), 256), 1, 24))


def bundle_digest(inputs: DataFrame, role: str = "role", sha: str = "sha256") -> DataFrame:
    """One row: digest of all ``role:sha`` in sorted order."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", role, sha)))
    return inputs.agg(F.sha2(F.array_join(parts, "\0"), 256).alias("bundle_sha256"))


def claims(results: DataFrame, name: str, order: Sequence[str], values: Sequence[str], bundle: str) -> DataFrame:
    """Lineage of result rows: claim_id, row_number (from 2, as a line of a file with a header), value, row and bundle digests."""
    value = F.coalesce(*(F.when(strip(v) != "", strip(v)) for v in values))
    numbered = batches(results, order).withColumn("row_number", (F.col("row_number") + 1).cast("int"))
    return numbered.select(
        F.concat(F.lit(f"{name}:"), F.lpad(F.col("row_number").cast("string"), 6, "0")).alias("claim_id"), F.lit(name).alias("table"), "row_number",
        value.alias("reported_value"), joined_digest(results.columns).alias("row_sha256"), F.lit(bundle).alias("bundle_sha256"),
    )


def ledger_faults(ledger: DataFrame, seen: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Rows (path, fault) of a ledger (path, bytes, sha256) held against the files that are there."""
    twice = ledger.groupBy("path").count().filter("count > 1").select("path", F.lit("repeated").alias("fault"))
    both = ledger.select("path", F.col("bytes").alias("b"), F.col("sha256").alias("s")).join(seen, "path", "full")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("s").isNull(), "not in ledger").when(F.col("b") != F.col("bytes"), "size").when(F.lower("s") != F.lower("sha256"), "digest")
    out = both.select("path", fault.alias("fault")).filter("fault is not null").unionByName(twice)
    if required:
        asked = ledger.sparkSession.createDataFrame([(p,) for p in required], "path string")
        out = out.unionByName(asked.join(ledger, "path", "left_anti").select("path", F.lit("required").alias("fault")))
    return out


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, inputs: dict[str, str] | None = None) -> dict:
    """Writes a package at ``path`` whole or not at all: tables, ledger, manifest and a frozen marker.

    It is built beside the target, the inputs' digests are read again before the last step, and a folder that is there
    already is left alone. inputs: path to the digest that was read.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, work = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.building"))
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    fs.delete(work, True)
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{path}.building/tables/{name}")
        ledger = files(spark, f"{path}.building/tables").withColumn("path", F.regexp_extract("path", r"\.building/(tables/.*)$", 1)).filter(F.col("path").rlike(r"\.parquet$"))
        ledger.coalesce(1).write.option("header", True).csv(f"{path}.building/ledger")
        digest = ledger.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256"))), "\0"), 256)).first()[0]
        manifest = {"tables": sorted(tables), "ledger_sha256": digest, "inputs": inputs or {}}
        for p, sha in (inputs or {}).items():
            if files(spark, p).first()["sha256"] != sha:
                raise ValueError(f"{p} changed while the package was built")
        for name, text in (("manifest.json", json.dumps(manifest, sort_keys=True)), ("FROZEN.json", json.dumps({"ledger_sha256": digest}))):
            out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}.building/{name}"), False)
            out.write(bytearray(text.encode()))
            out.close()
        if not fs.rename(work, target):
            raise FileExistsError(path)
        return manifest
    except BaseException:
        fs.delete(work, True)
        raise
