"""From collected records to canonical works: candidates, reviews, versions, extraction, audit, corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import doi, squeeze, unique_texts
from ..operators import agreement as A
from ..operators import linkage as L
from ..operators import overlay as O
from ..operators import sampling as M
from ..operators import screening as S
from ..sources.sinks import joined_digest

BLINDED = ("paper_id", "title", "abstract", "keywords", "year", "record_type")


def build_screening_candidates(records: DataFrame, domains: dict[str, str], batch: int = 50) -> dict[str, DataFrame]:
    """Candidates in numbered batches, their blinded view, and the records outside.

    records: paper_id, title, abstract, keywords (array) and more. A candidate hits every domain in its title, abstract
    or keywords.
    """
    flat = records.withColumns({"title": squeeze("title"), "abstract": squeeze("abstract"), "keywords": unique_texts("keywords")}).withColumn("__k", F.array_join("keywords", "; "))
    kept = S.candidates(flat, ["title", "abstract", "__k"], domains).drop("__k").withColumn("abstract_missing", F.col("abstract") == "")
    numbered = M.batches(kept, ["paper_id"], batch)
    return {"candidates": numbered, "blinded": numbered.select(*(c for c in BLINDED if c in numbered.columns), "batch", "row_number"), "outside": records.join(kept.select("paper_id"), "paper_id", "left_anti")}


def compare_reviews(master: DataFrame, one: DataFrame, two: DataFrame, criteria: Sequence[str] = S.CRITERIA) -> dict[str, DataFrame]:
    """Comparisons, the queue of those that need adjudication, counts by class, and faults of either review."""
    rules = S.decision_rules()
    faults = S.violations(one, rules, ["paper_id"]).withColumn("reviewer", F.lit("A")).unionByName(S.violations(two, rules, ["paper_id"]).withColumn("reviewer", F.lit("B")))
    both = A.compare_reviews(master, one, two, "paper_id", criteria)
    return {"comparisons": both, "queue": both.filter("needs_adjudication"), "classes": both.groupBy("comparison_class").agg(F.count("*").alias("n")), "faults": faults}


def finalize_screening(comparisons: DataFrame, adjudications: DataFrame, version_flags: DataFrame | None = None) -> dict[str, DataFrame]:
    """Final decisions, their counts, and edges between records that reviewers took for versions of one work."""
    final = A.resolve(comparisons, adjudications, "paper_id")
    out = {"final": final, "decisions": final.groupBy("final_decision").agg(F.count("*").alias("n")), "codes": final.filter("final_decision = 'EXCLUDE'").groupBy("final_primary_code").agg(F.count("*").alias("n"))}
    if version_flags is not None:
        out["edges"] = L.edges(version_flags, "source_paper_id", "target_paper_id", "relationship_id")
    return out


def prepare_review_package(records: DataFrame, flagged: DataFrame) -> dict[str, DataFrame]:
    """Pairs of records to be judged as versions, and DOIs that several records share."""
    return {"pairs": L.version_pairs(records, flagged), "shared_dois": L.shared_dois(records, "paper_id")}


def finalize_consolidation(members: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """Families with their ids and preferred members, one work for each, and pairs that contradict them.

    members: paper_id, provisional_family_id, preferred (boolean); pairs: left, right, same (boolean).
    """
    family = L.families(members, "provisional_family_id", "paper_id", "preferred", "VWF2-")
    sizes = family.select("provisional_family_id", "family_size").distinct().groupBy("family_size").agg(F.count("*").alias("families"))
    return {"families": family, "works": family.filter("preferred"), "sizes": sizes, "faults": L.pair_family_faults(pairs, members, "provisional_family_id", "paper_id")}


def prepare_extraction_batches(works: DataFrame, batch: int = 25) -> DataFrame:
    """Works in numbered batches, each with the digest of its row."""
    return M.batches(works, ["paper_id"], batch).withColumn("source_row_sha256", joined_digest(works.columns))


def finalize_extraction(template: DataFrame, filled: DataFrame, protected: Sequence[str], rules: dict[str, Column]) -> dict[str, DataFrame]:
    """The filled-in rows, cells that had to stay but didn't, and broken rules."""
    return {"extraction": filled, "changed_cells": O.protected_faults(template, filled, "paper_id", protected), "faults": S.violations(filled, rules, ["paper_id"])}


def build_human_audit_package(comparisons: DataFrame, outside: DataFrame, seed: str, boundary: dict[str, int], target: dict[str, int]) -> DataFrame:
    """A blinded sample of four groups: difficult, agreed include, agreed exclude, and near misses outside the frame.

    comparisons: paper_id, missing, uncertain, disagree, agreed_include, agreed_exclude; outside: paper_id, pool. target:
    sizes of the groups difficult, include, exclude, boundary; boundary: base quotas of the outside pools, which make up for each other.
    """
    first = M.difficult(comparisons, seed, "paper_id", target["difficult"]).withColumn("sample_group", F.lit("difficult"))

    def agreed(flag: str, name: str) -> DataFrame:
        pool = comparisons.filter(flag).withColumn("component", F.lit(name))
        return M.sample(pool, seed, "component", "paper_id", target[name]).select("paper_id", "component", F.lit(name).alias("sample_group"))

    quotas = M.boundary_quotas(M.pool_sizes(outside, "pool"), boundary, target["boundary"])
    ranked = M.ranked_pools(outside, seed, "pool", "paper_id")
    near = ranked.filter(" or ".join(f"(pool = '{p}' and pool_rank <= {q})" for p, q in quotas.items())).select("paper_id", F.col("pool").alias("component"), F.lit("boundary").alias("sample_group"))
    whole = first.unionByName(agreed("agreed_include", "include")).unionByName(agreed("agreed_exclude", "exclude")).unionByName(near)
    return M.blinded(whole, seed, "paper_id")


def finalize_human_audit(sample: DataFrame, responses: DataFrame, models: DataFrame) -> dict[str, DataFrame]:
    """Human against final decisions by group and component, with exact intervals, and the records that need a second look.

    responses: audit_id, human_decision; models: paper_id, final_decision.
    """
    got = sample.join(responses, "audit_id", "left").join(models, "paper_id", "left")
    wrong = (F.col("human_decision") != "UNCERTAIN") & (F.col("human_decision") != F.coalesce("final_decision", F.lit("EXCLUDE")))
    got = got.withColumns({"disagrees": wrong, "second_review": wrong | (F.col("human_decision") == "UNCERTAIN")})
    table = got.rollup("sample_group", "component").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum(F.col("disagrees").cast("long")).alias("k")).filter("g < 3")
    table = table.withColumn("component", F.when(F.col("g") == 1, "ALL").otherwise(F.col("component"))).drop("g")
    return {"rows": got, "strata": A.proportions(table, "k", "n"), "second_review": got.filter("second_review").select("audit_id", "paper_id")}


def apply_corrections(works: DataFrame, corrections: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Corrected works, a ledger with digests of the rows before and after, and faults of what came out.

    corrections: paper_id, field, expected_old, new_value.
    """
    fixed = O.corrected(works, corrections, "paper_id", columns)
    digest = lambda df, n: df.select("paper_id", joined_digest(works.columns).alias(n))
    ledger = corrections.join(digest(works, "sha256_before"), "paper_id").join(digest(fixed, "sha256_after"), "paper_id")
    faults = L.shared_dois(fixed, "paper_id").select(F.concat(F.lit("shared DOI: "), "doi").alias("fault")) if "doi" in works.columns else works.limit(0).select(F.lit("").alias("fault"))
    if {"year", "publication_date"} <= set(works.columns):
        apart = fixed.filter("publication_date is not null and publication_date <> '' and substring(publication_date, 1, 4) <> cast(year as string)")
        faults = faults.unionByName(apart.select(F.concat(F.lit("year and date differ: "), F.col("paper_id").cast("string")).alias("fault")))
    return {"works": fixed, "ledger": ledger, "faults": faults}


def integrate(base: DataFrame, more: DataFrame, names: tuple[str, str] = ("base", "increment"), family: str = "version_family_id") -> dict[str, DataFrame]:
    """Two screened corpora as one, its works (preferred rows) and how many rows of each kind there are."""
    both = L.integrate(base, more, names, "source_corpus")
    both = both.withColumn("record_key", F.concat_ws(":", "source_corpus", F.col("paper_id").cast("string")))
    works = both.filter(F.col("preferred_for_analysis").cast("string").isin("true", "yes", "1")) if "preferred_for_analysis" in both.columns else both
    counts = both.groupBy("source_corpus").agg(F.count("*").alias("rows"), F.count_distinct(family).alias("families")) if family in both.columns else both.groupBy("source_corpus").agg(F.count("*").alias("rows"))
    return {"rows": both, "works": works, "counts": counts}


def normal_dois(df: DataFrame, column: str = "doi") -> DataFrame:
    return df.withColumn(column, doi(column))
