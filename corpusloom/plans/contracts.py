"""Contracts of a selection and of a finished analysis, as tables of what breaks them, and the production run that keeps them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import EXCLUSIONS
from ..sources import tables as T
from ..sources.sinks import ledger_faults, publish
from . import analysis as N

# Retrieval sources in their order, and date statuses.
SOURCES = ("openalex", "pubmed", "europepmc", "semantic_scholar", "doaj", "scopus")
DATE_STATUSES = ("inside_window", "before_window", "after_window", "unknown", "unresolved_boundary")

#: Sums of a selection that must agree: rule, relation, and terms (sign, group, part). Part "total" is a group's stated sum,
#: "*" the sum of its other parts; relation = holds between the sum of all terms and zero, <= likewise.
EQUATIONS = (
    ("sources sum to all retrievals", "=", ((1, "retrievals", "*"), (-1, "retrievals", "total"))),
    ("cutoff within its source", "<=", ((1, "cutoff", "total"), (-1, "retrievals", "scopus"))),
    ("retrievals less the cutoff", "=", ((1, "retrievals", "total"), (-1, "cutoff", "total"), (-1, "after_cutoff", "total"))),
    ("date statuses sum to the other sources", "=", ((1, "date_status", "*"), (-1, "retrievals", "*"), (1, "retrievals", "scopus"))),
    ("automatic merges sum", "=", ((1, "automatic_merges", "*"), (-1, "automatic_merges", "total"))),
    ("records after automatic merges", "=", ((1, "after_cutoff", "total"), (-1, "automatic_merges", "total"), (-1, "after_automatic", "total"))),
    ("reviewed merges sum", "=", ((1, "reviewed_merges", "*"), (-1, "reviewed_merges", "total"))),
    ("deduplicated records", "=", ((1, "after_automatic", "total"), (-1, "reviewed_merges", "total"), (-1, "deduplicated", "total"))),
    ("candidates sum", "=", ((1, "candidates", "*"), (-1, "candidates", "total"))),
    ("records outside the frame", "=", ((1, "deduplicated", "total"), (-1, "candidates", "total"), (-1, "outside", "total"))),
    ("resolution checks sum", "=", ((1, "resolution", "*"), (-1, "resolution", "total"))),
    ("resolution within the candidates", "<=", ((1, "resolution", "total"), (-1, "candidates", "total"))),
    ("out of range within the candidates", "<=", ((1, "out_of_range", "total"), (-1, "candidates", "total"))),
    ("decisions sum to the candidates", "=", ((1, "included", "total"), (1, "excluded", "total"), (-1, "candidates", "total"))),
    ("works within the included records", "<=", ((1, "works", "total"), (-1, "included", "total"))),
)
#: Groups whose parts are given by name.
PARTS = {"retrievals": SOURCES, "date_status": DATE_STATUSES}
#: Groups that a selection may leave open until it is final.
FINAL = ("included", "excluded", "works")


def selection_faults(selection: DataFrame, final: bool = True) -> DataFrame:
    """(rule, amount) of what doesn't add up in a selection (group, part, count); amount is by how much.

    Counts are whole and not negative; each group has a row with part total or its parts by name. A selection that isn't
    final may lack the groups of FINAL, whose rules are then passed over.
    """
    spark = selection.sparkSession
    rows = selection.select(F.col("group").alias("g"), F.col("part").alias("p"), F.col("count").cast("long").alias("n"))
    rules = spark.createDataFrame([(i, r, rel, len(ts), s, g, p) for i, (r, rel, ts) in enumerate(EQUATIONS) for s, g, p in ts], "i int, rule string, relation string, terms int, sign int, g string, p string")
    sums = rows.groupBy("g").agg(F.sum(F.when(F.col("p") != "total", F.col("n"))).alias("n")).select("g", F.lit("*").alias("p"), "n")
    known = rows.unionByName(sums.filter("n is not null"))
    terms = F.broadcast(rules).join(known, ["g", "p"], "left")  # a row for each term of the rules
    told = terms.groupBy("i", "rule", "relation").agg(F.sum(F.col("sign") * F.col("n")).alias("amount"), F.sum(F.col("n").isNull().cast("int")).alias("lacking"), F.max(F.col("g").isin(*FINAL)).alias("late"))
    broken = F.when(F.col("lacking") > 0, F.lit(final) | ~F.col("late")).when(F.col("relation") == "=", F.col("amount") != 0).otherwise(F.col("amount") > 0)
    out = told.filter(broken).select(F.when(F.col("lacking") > 0, F.concat(F.lit("lacks a count: "), "rule")).otherwise(F.col("rule")).alias("rule"), F.when(F.col("lacking") == 0, F.col("amount")).alias("amount"))
    bad = rows.filter("n is null or n < 0").select(F.concat(F.lit("not a count: "), "g", F.lit("/"), "p").alias("rule"), F.col("n").alias("amount"))
    twice = rows.groupBy("g", "p").count().filter("count > 1").select(F.concat(F.lit("given twice: "), "g", F.lit("/"), "p").alias("rule"), F.col("count").alias("amount"))
    names = spark.createDataFrame([(g, p) for g, ps in PARTS.items() for p in ps], "g string, p string").withColumn("known", F.lit(True))
    named = rows.filter(F.col("g").isin(*PARTS) & (F.col("p") != "total")).select("g", "p", "n").join(F.broadcast(names), ["g", "p"], "full")
    odd = named.filter("known is null or n is null").select(F.concat(F.when(F.col("known").isNull(), "unknown part: ").otherwise("lacks a part: "), "g", F.lit("/"), "p").alias("rule"), F.lit(None).cast("long").alias("amount"))
    return out.unionByName(bad).unionByName(twice).unionByName(odd)


# Fields whose coverage a published analysis gives, tables that it must have, and words that no table's name may hold.
COVERAGE = ("date", "abstract", "source", "authors", "countries", "access", "citations", "models", "methods", "skills", "specialty", "design")
REQUIRED = (
    "years", "access", "sources", "coverage", "citations", "citations_by_year", "countries", "collaboration", "author_links", "authors", "author_bands",
    "phrases", "phrases_with_abstract", "phrase_pairs", "phrase_network", "phrase_indicators", "claims",
)
PROHIBITED = ("word_cloud", "wordcloud", "urology_only")


def analysis_faults(tables: dict[str, DataFrame], works: DataFrame, required: Sequence[str] = REQUIRED, coverage: Sequence[str] = COVERAGE) -> DataFrame:
    """(rule, detail) of what a finished analysis lacks or contradicts; each rule is a small query over its tables."""
    spark = works.sparkSession
    names = [("table is absent", n) for n in required if n not in tables] + [("prohibited table", n) for n in tables if any(p in n.lower() for p in PROHIBITED)]
    out = spark.createDataFrame(names, "rule string, detail string")
    n = works.agg(F.count("*").alias("__n"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def found(rule: str, df: DataFrame, detail) -> None:
        nonlocal out
        out = out.unionByName(df.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))

    if "coverage" in tables:
        c = tables["coverage"].crossJoin(F.broadcast(n))  # one row
        found("coverage doesn't sum to all works", c.filter("present + missing <> __n or denominator <> __n"), F.col("measure"))
        asked = spark.createDataFrame([(m,) for m in coverage], "measure string")
        found("coverage is absent", asked.join(c, "measure", "left_anti"), F.col("measure"))
        found("coverage given twice", c.groupBy("measure").count().filter("count > 1"), F.col("measure"))
    for name in ("years", "access"):
        if name in tables:
            total = tables[name].agg(F.coalesce(F.sum("count"), F.lit(0)).alias("s")).crossJoin(F.broadcast(n))  # one row
            found(f"{name} don't sum to all works", total.filter("s <> __n"), F.col("s"))
    if "access" in tables:
        kinds = spark.createDataFrame([(a,) for a in N.ACCESS], "label string")
        found("access category is absent", kinds.join(tables["access"], "label", "left_anti"), F.col("label"))
    if "countries" in tables:
        c = tables["countries"]
        found("country without both counts", c.filter("whole is null or fractional is null or fractional > whole + 1e-6"), F.col("country"))
        shared = c.agg(F.sum("fractional").alias("s"), F.max("covered").alias("covered"), F.count("*").alias("m"))
        found("shares don't sum to the covered works", shared.filter("abs(s - covered) > 1e-6 * (m + 1)"), F.col("s"))
    if {"author_links", "authors", "author_bands"} <= set(tables):
        links = tables["author_links"].select("work", "identity").distinct().groupBy("identity").agg(F.count("*").alias("__w"))
        both = links.join(tables["authors"].select("identity", "works"), "identity", "full")
        found("author ledgers differ", both.filter("not (__w <=> works)"), F.col("identity"))
        found("author without key", tables["author_links"].filter(F.coalesce(F.trim("identity"), F.lit("")) == ""), F.col("work"))
        counted = tables["authors"].agg(F.count("*").alias("a")).crossJoin(F.broadcast(tables["author_bands"].agg(F.coalesce(F.sum("identities"), F.lit(0)).alias("b"))))  # one row
        found("bands don't sum to all authors", counted.filter("a <> b"), F.col("b"))
    if {"phrases", "phrase_network"} <= set(tables):
        p, e = tables["phrases"], tables["phrase_network"]
        sizes = e.select(F.col("left").alias("label"), F.col("left_works").alias("__s")).unionByName(e.select(F.col("right").alias("label"), F.col("right_works").alias("__s"))).distinct()
        found("node size isn't the phrase's count", sizes.join(p.select("label", F.col("works").alias("__c")), "label", "left").filter("not (__s <=> __c)"), F.col("label"))
    for name in ("phrases", "phrases_with_abstract"):
        if name in tables:
            p = tables[name]
            lacking = [(f,) for f in ("title", "abstract", "keywords") if f not in p.columns]
            found(f"{name}: count by field is absent", spark.createDataFrame(lacking, "x string"), F.col("x"))
            fields = [f for f in ("title", "abstract", "keywords") if f in p.columns]
            found(f"{name}: more works in a field than at all", p.filter(F.greatest(F.lit(0), F.lit(0), *fields) > F.col("works")), F.col("label"))
    if "claims" in tables:
        c = tables["claims"]
        found("claim without a bound input", c.filter(~text("bundle_sha256").rlike("^[0-9a-f]{64}$")), F.col("claim_id"))
        found("no claims", c.agg(F.count("*").alias("k")).filter("k = 0"), F.col("k"))
    return out


def tiny_share_faults(counts: DataFrame) -> DataFrame:
    """(label, shown) of positive shares below 0.1 % that aren't shown as such. counts: label, count, denominator, shown."""
    tiny = (F.col("count") > 0) & (100.0 * F.col("count") / F.col("denominator") < 0.1)
    return counts.filter(tiny & ~F.col("shown").eqNullSafe(F.lit("<0.1%"))).select("label", "shown")


def exclusion_labels(counts: DataFrame, code: str = "label") -> DataFrame:
    """counts with the reader-facing text of exclusion codes in ``display``; an unknown code is an error."""
    names = F.create_map(*(F.lit(x) for kv in EXCLUSIONS.items() for x in kv))
    bad = F.raise_error(F.concat(F.lit("unknown exclusion code: "), F.col(code))).cast("string")
    return counts.withColumn("display", F.coalesce(F.try_element_at(names, F.col(code)), bad))


# -- production ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Pin:
    """An input file of CSV: where it is, and what it must be."""

    path: str
    sha256: str
    rows: int | None = None
    size: int | None = None
    required: Sequence[str] = ()


@dataclass(frozen=True)
class Production:
    """What a production run is bound to: pins by role (works and metadata at least), the selection, and the analysis."""

    pins: dict[str, Pin]
    selection: Sequence[tuple[str, str, int]]
    config: N.Config
    required: Sequence[str] = REQUIRED
    coverage: Sequence[str] = COVERAGE
    extra: dict[str, str] = field(default_factory=dict)


class ContractFault(ValueError):
    """A contract that doesn't hold; its text names the first faults."""


def _none(faults: DataFrame, what: str) -> None:
    if rows := faults.limit(5).collect():
        raise ContractFault(f"{what}: " + "; ".join(str(tuple(r)) for r in rows))


def preflight(spark: SparkSession, production: Production) -> dict[str, DataFrame]:
    """The pinned tables by role, once every pin and the selection hold."""
    out = {}
    for role, pin in production.pins.items():
        out[role] = T.pinned(spark, pin.path, T.csv_any(spark, pin.path, list(pin.required)), pin.sha256, pin.size, pin.rows, pin.required)
    selection = spark.createDataFrame(list(production.selection), "group string, part string, count long")
    _none(selection_faults(selection), "selection")
    if works := dict((g, n) for g, p, n in production.selection if p == "total").get("works"):
        if out["works"].count() != works:
            raise ContractFault("the works aren't as many as the selection says")
    N.preflight(out["works"], out["metadata"])
    return out


def run_production(spark: SparkSession, production: Production, path: str) -> dict:
    """Checks inputs and selection, computes every table, checks what came out and publishes the package; returns its manifest.

    Inputs are read again before the package takes its place, so that none has changed meanwhile.
    """
    inputs = preflight(spark, production)
    made = N.build_analysis(inputs["works"], inputs["metadata"], production.config, inputs.get("comparisons"))
    bundle = T.bundle({r: p.sha256 for r, p in production.pins.items()})
    made["claims"] = N.claim_register(made, bundle)
    selection = spark.createDataFrame(list(production.selection), "group string, part string, count long")
    made["selection"] = selection
    stored = {n: N.kept(df) for n, df in made.items()}
    _none(analysis_faults(stored, inputs["works"], production.required, production.coverage), "analysis")
    return publish(spark, stored, path, {p.path: p.sha256 for p in production.pins.values()})


def validate_package(spark: SparkSession, path: str) -> DataFrame:
    """(path, fault) of what a published package's files, ledger, manifest and marker say differently; no rows if it is whole."""
    seen = T.files(spark, f"{path}/tables").withColumn("path", F.regexp_extract("path", r"/(tables/.*)$", 1)).filter(F.col("path").rlike(r"\.parquet$"))
    ledger = spark.read.option("header", True).schema("path string, bytes long, sha256 string").csv(f"{path}/ledger")
    read = lambda name: json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/{name}").collect()))
    manifest, frozen = read("manifest.json"), read("FROZEN.json")
    digest = ledger.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256"))), "\0"), 256)).first()[0]
    own = [(name, "digest of the ledger") for name, x in (("manifest.json", manifest), ("FROZEN.json", frozen)) if x.get("ledger_sha256") != digest]
    there = ledger.select(F.regexp_extract("path", r"^tables/([^/]+)/", 1).alias("t")).distinct()
    asked = spark.createDataFrame([(t,) for t in manifest["tables"]], "t string")
    odd = asked.join(there, "t", "left_anti").select(F.concat(F.lit("tables/"), "t").alias("path"), F.lit("table without files").alias("fault"))
    return ledger_faults(ledger, seen).unionByName(odd).unionByName(spark.createDataFrame(own, "path string, fault string"))
