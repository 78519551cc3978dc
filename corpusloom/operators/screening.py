"""Candidate filters and the rules that screening rows must keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import list_faults, split_list, strip

# Controlled labels of screening decisions.
DECISIONS = ("INCLUDE", "EXCLUDE", "UNCERTAIN")
CRITERIA = ("llm_explicit", "health_professions_education", "simulation_central", "eligible_document_type", "date_eligible", "language_assessable")
EXCLUSION_CODES = ("E1_NOT_LLM", "E2_NOT_HEALTH_ED", "E3_NOT_SIMULATION", "E4_CLINICAL_ONLY", "E5_INELIGIBLE_TYPE", "E6_OUT_OF_RANGE", "E7_NOT_ASSESSABLE_IN_ENGLISH", "E9_OTHER")
UNCERTAIN_CODES = ("U1_NEED_FULL_TEXT", "U2_NEED_MODEL_DETAIL", "U3_NEED_DOCUMENT_TYPE", "U4_NEED_VERSION_CHECK", "U5_NEED_LANGUAGE_CHECK", "U6_NEED_DATE_CHECK")
CODE_GATES = {
    "E1_NOT_LLM": ("llm_explicit", "no"),
    "E2_NOT_HEALTH_ED": ("health_professions_education", "no"),
    "E3_NOT_SIMULATION": ("simulation_central", "no"),
    "E4_CLINICAL_ONLY": ("health_professions_education", "no"),
    "E5_INELIGIBLE_TYPE": ("eligible_document_type", "no"),
    "E6_OUT_OF_RANGE": ("date_eligible", "no"),
    "E7_NOT_ASSESSABLE_IN_ENGLISH": ("language_assessable", "no"),
    "U2_NEED_MODEL_DETAIL": ("llm_explicit", "unclear"),
    "U3_NEED_DOCUMENT_TYPE": ("eligible_document_type", "unclear"),
    "U5_NEED_LANGUAGE_CHECK": ("language_assessable", "unclear"),
    "U6_NEED_DATE_CHECK": ("date_eligible", "unclear"),
}


def domain_hits(df: DataFrame, fields: Sequence[str], domains: dict[str, str], prefix: str = "hit_") -> DataFrame:
    """df with one boolean for each domain pattern over the fields joined by line breaks.

    Patterns are written as for any language's Unicode words; they are literals, so that a task compiles them once.
    """
    text = F.concat_ws("\n", *(F.coalesce(F.col(f), F.lit("")) for f in fields))
    return df.withColumn("__t", text).withColumns({f"{prefix}{d}": F.col("__t").rlike(f"(?iU){p}") for d, p in domains.items()}).drop("__t")


def candidates(df: DataFrame, fields: Sequence[str], domains: dict[str, str]) -> DataFrame:
    """Rows that hit every domain."""
    hit = domain_hits(df, fields, domains)
    return hit.filter(" and ".join(f"hit_{d}" for d in domains)).drop(*(f"hit_{d}" for d in domains))


def near_misses(df: DataFrame, fields: Sequence[str], domains: dict[str, str], anchor: str, names: dict[str, str]) -> DataFrame:
    """Rows that hit the anchor domain and all others but one, with that one's pool name in ``pool``."""
    others = [d for d in domains if d != anchor]
    hit = domain_hits(df, fields, domains).filter(f"hit_{anchor}")
    pool = F.coalesce(*(F.when(~F.col(f"hit_{d}") & F.forall(F.array(*(F.col(f"hit_{o}") for o in others if o != d)), lambda x: x), names[d]) for d in others))
    return hit.withColumn("pool", pool).filter("pool is not null").drop(*(f"hit_{d}" for d in domains))


def violations(df: DataFrame, rules: dict[str, Column], key: Sequence[str]) -> DataFrame:
    """(key..., rule) of rules that are broken: a rule is a condition of a fault; an unknown condition is no fault."""
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return df.select(*key, F.explode(broken).alias("rule"))


def decision_rules(final: bool = False) -> dict[str, Column]:
    """Faults of a decision, its code and its criteria."""
    d, code = F.col("decision"), F.col("primary_code")
    values = F.array(*(F.col(c) for c in CRITERIA))
    some = lambda v: F.exists(values, lambda x: x == v)
    every = F.forall(values, lambda x: x == "yes")
    right = F.when(d == "INCLUDE", code == "INCLUDE").when(d == "EXCLUDE", code.isin(*EXCLUSION_CODES)).otherwise(code.isin(*UNCERTAIN_CODES))
    rules = {
        "decision": ~d.isin(*(DECISIONS[:2] if final else DECISIONS)),
        "retired code": code.startswith("E8"),
        "decision and code": ~right,
        "criterion value": F.exists(values, lambda x: ~x.isin("yes", "no", "unclear")),
        "included without all criteria": (d == "INCLUDE") & ~every,
        "excluded without a failed criterion": (d == "EXCLUDE") & ~some("no"),
        "uncertain with a failed criterion": (d == "UNCERTAIN") & some("no"),
        "uncertain without an unclear criterion": (d == "UNCERTAIN") & ~some("unclear"),
        "full text without an unclear criterion": (code == "U1_NEED_FULL_TEXT") & ~((F.col("health_professions_education") == "unclear") | (F.col("simulation_central") == "unclear") | (F.col("eligible_document_type") == "unclear")),
    }
    gates = [(code == k) & (F.col(c) != v) for k, (c, v) in CODE_GATES.items()]
    rules["code and criterion"] = F.greatest(*gates)
    return rules


def list_rules(lists: dict[str, Sequence[str]]) -> dict[str, Column]:
    """Faults of ``;`` lists of controlled labels (column to its labels): blank, repeated and unknown items."""
    unknown = lambda allowed: lambda x: ~x.isin(*allowed)
    rules: dict[str, Column] = {}
    for c, allowed in lists.items():
        wrong = list_faults(c)
        rules |= {f"{c}: blank item": wrong == "blank item", f"{c}: repeated item": wrong == "repeated item"}
        rules[f"{c}: unknown label"] = F.exists(split_list(c), unknown(allowed))
    return rules


def review_rules(key: str = "paper_id", lists: dict[str, Sequence[str]] | None = None) -> dict[str, Column]:
    """Faults of a review row: untrimmed or many-lined evidence, a version that is the record itself, faults of controlled lists."""
    ev = F.col("evidence")
    return list_rules(lists or {}) | {
        "outer white space": ev.rlike(r"(?U)^\s|\s$"),
        "evidence over several lines": ev.contains("\n") | ev.contains("\r"),
        "blank evidence": F.coalesce(F.trim(ev), F.lit("")) == "",
        "version of itself": F.col("possible_version_of") == F.col(key),
    }


def conditional_fields(condition: Column, required: Sequence[str], blank: Sequence[str]) -> dict[str, Column]:
    """Faults of fields that a condition requires, and of fields that must be blank without it."""
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    return {f"{c} required": condition & empty(c) for c in required} | {f"{c} must be blank": ~condition & ~empty(c) for c in blank}


def minutes_rules(column: str) -> dict[str, Column]:
    """Faults of a time that may be blank: text that isn't a finite number, and negative numbers."""
    text, value = strip(column), strip(column).try_cast("double")
    given = text != ""
    return {f"{column}: not a finite number": given & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))), f"{column}: negative": given & (value < 0)}


def marker_rules(rationale: str, markers: dict[str, tuple[Column, str]]) -> dict[str, Column]:
    """Faults of rationales that lack the marker which a condition asks for: name to (condition, marker)."""
    text = F.coalesce(F.col(rationale), F.lit(""))
    return {name: condition & ~text.contains(marker) for name, (condition, marker) in markers.items()}


# Relationships of two versions of a work, and the roles that they ask for: any of each group.
SAME_WORK, OTHER_WORK = "SAME_SCHOLARLY_WORK_VERSION", "DISTINCT_SCHOLARLY_WORK"
ROLES_OF = {
    "preprint_to_journal": (("preprint",), ("final_journal_article",)),
    "conference_to_journal": (("final_journal_article",), ("conference_full_paper", "conference_abstract")),
    "correction_of": (("correction",),),
    "supplement_of": (("supplement",),),
    "translated_version": (("translated_publication",),),
}


def role_faults(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(left, right, relationship, lacking) of pairs of one work whose ends lack a role that their relationship asks for.

    pairs: left, right, decision, relationship; members: key, version_role. The table of asked roles has a row for each
    group; a pair lacks a group if neither end has one of its roles.
    """
    asked = pairs.sparkSession.createDataFrame([(r, list(g)) for r, gs in ROLES_OF.items() for g in gs], "relationship string, roles array<string>")
    role = lambda side: members.select(F.col(key).alias(side), F.col("version_role").alias(f"{side}_role"))
    held = pairs.filter(F.col("decision") == SAME_WORK).join(role("left"), "left").join(role("right"), "right").join(F.broadcast(asked), "relationship")  # seven rows
    lacking = ~F.array_contains("roles", F.col("left_role")) & ~F.array_contains("roles", F.col("right_role"))
    return held.filter(lacking).select("left", "right", "relationship", F.array_join("roles", " or ").alias("lacking"))


def extraction_rules(labels: dict[str, Sequence[str]], rationale: str, url: str, placeholders: Sequence[str] = ("tbd", "n/a", "todo", "unknown")) -> dict[str, Column]:
    """Faults of an extraction row: label arrays in another than the agreed order, unknown or repeated labels, placeholders, short rationales, bad addresses."""
    def in_order(c: str, allowed: Sequence[str]) -> Column:
        order = F.array(*(F.lit(x) for x in allowed))
        return F.transform(F.col(c), lambda x: F.array_position(order, x))

    rules: dict[str, Column] = {}
    for c, allowed in labels.items():
        places = in_order(c, allowed)
        rules[f"{c}: unknown label"] = F.exists(places, lambda p: p == 0)
        rules[f"{c}: repeated label"] = F.size(F.array_distinct(c)) < F.size(c)
        rules[f"{c}: order"] = F.array_sort(places) != places
    text = F.trim(F.col(rationale))
    rules["placeholder"] = F.lower(text).isin(*placeholders)
    rules["short rationale"] = F.length(text) < 20
    rules["address"] = F.col(url).isNotNull() & ~F.col(url).rlike(r"^https?://[^\s/?#]+\.[^\s/?#]+")
    return rules


def total_faults(df: DataFrame, equations: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(rule, left, right) of sums of a one-row table that don't agree."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), a.cast("long").alias("left"), b.cast("long").alias("right")) for n, (a, b) in equations.items())))
    return df.select(rows.alias("r")).select("r.*").filter("not (left <=> right)")
