"""Line dedup by overlapping windows of three lines.

Lines that hold more than white space are numbered in each document; three in a row are a window, known by 128 bits of hash over
the trimmed lines. Windows that occur again, in any document, lose all but their first occurrence: the lines
of later ones are covered, overlapping windows are merged, and covered lines (with empty ones between) are taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored, table

WINDOW = 3
TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _windows(lines: Column, places: Column) -> Column:
    """Structs (h1, h2, first, last) of each window; places: numbers of the lines that aren't blank."""
    line = lambda i, k: F.regexp_replace(F.element_at(lines, F.element_at(places, i + k) + 1), TRIM, "")

    def one(i: Column) -> Column:
        three = [line(i, k) for k in range(WINDOW)]
        return F.struct(F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit("#"), *three).alias("h2"), F.element_at(places, i).alias("first"), F.element_at(places, i + WINDOW - 1).alias("last"))

    n = F.size(places)
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), one))


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with the text less its repeated passages, and with n_lines and removed_lines (long).

    The first occurrence is the one of the smallest (doc_id, line), null ids first, among the documents of an id the one
    of the smallest hash of the text. Rows with equal id and text are one document given several times and
    each get its result. A null text stays null (no lines); a text with fewer than three lines that hold words is
    left as it is. Columns named n_lines or removed_lines are replaced, __key, __doc, __lines, __id, __hash and
    __covered left out; an empty table gives an empty table.
    """
    docs = dropped(documents, "n_lines", "removed_lines", "__key", "__doc", "__lines", "__id", "__hash", "__covered")
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    lines = F.split(F.col(text), "\n", -1)
    seen = docs.filter(F.col(text).isNotNull()).select(key.alias("key"), lines.alias("lines"))
    seen = seen.withColumn("places", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.element_at("lines", i + 1).rlike(r"[^\x20\x09-\x0D]")))
    windows = stored(seen.select("key", F.explode(_windows(F.col("lines"), F.col("places"))).alias("w")).select("key.id", "key.hash", "w.*"), "windows")
    at = F.struct("id", "hash", "first")
    counts = windows.groupBy("h1", "h2").agg(F.min(at).alias("one"), F.max(at).alias("other"))
    again = stored(counts.filter(~F.col("one").eqNullSafe(F.col("other"))).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "one"), "repeated")
    later = windows.join(again, (windows["h1"] == again["g1"]) & (windows["h2"] == again["g2"])).filter(~at.eqNullSafe(F.col("one")))
    covered = later.groupBy("id", "hash").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    places = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["first"], r["last"]))))
    covered = stored(covered.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), places.alias("__covered")), "covered")
    keyed = docs.withColumns({"__key": F.xxhash64(text), "__doc": F.col(f"`{doc_id}`")})
    # a merge join at any size: what is joined carries the texts, and the other side has no size bound
    out = keyed.join(covered.hint("merge"), F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash")), "left").withColumn("__lines", lines)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__covered")), lambda i: F.element_at("__lines", i + 1))
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    columns[text] = F.when(F.col("__covered").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return out.select(*(v.alias(k) for k, v in columns.items()), F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(F.col("__covered")), F.lit(0)).cast("long").alias("removed_lines"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "removed_lines")


#: {docs}: a relation with doc_id and text, one row for each id.
SQL = r"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {docs}),
full_lines AS (SELECT doc_id, pos, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c, lead(pos, 2) OVER w AS last FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, pos, last FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM windows WHERE last IS NOT NULL) WHERE k > 1),
covered AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, last)) AS pos FROM later),
deduped AS (SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS text, count(*)::BIGINT AS n_lines, count(c.pos)::BIGINT AS removed_lines
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)"""

ORACLE = {"op4_line_dedup": "WITH " + SQL.format(docs="documents") + "\nSELECT doc_id, text, n_lines, removed_lines FROM deduped"}
