"""The analysis of a set of works: every table from one lazily evaluated plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import percent, shown_percent
from ..functions.text import display, missing, phrase_text, source_key, split_list, strip, year
from ..operators import agreement as A
from ..operators import frequency as Q
from ..operators import geography as G
from ..operators import overlay as O
from ..operators import phrases as P
from ..operators.lineage import cut
from ..operators.results import long_rows
from ..sources.sinks import claims, publish
from ..sources.tables import SchemaFault

# Open-access categories that always have a row.
ACCESS = ("gold", "green", "hybrid", "bronze", "diamond", "closed", "unknown")
WORK_COLUMNS = ("paper_id", "title", "abstract", "source_keywords", "year")
METADATA_COLUMNS = ("paper_id", "match_status", "oa_status", "cited_by_count", "authors_json", "source_id", "source_name", "source_issn_l")


@dataclass(frozen=True)
class Config:
    """first_year to last_year: the window; labels: multi-valued columns with their allowed labels (empty: any); single: columns of one label;
    phrases: dictionary; excluded: labels kept out of the network; partial_year: a year whose data aren't complete; checked: names of
    coverage measures with the column that must hold something."""

    first_year: int
    last_year: int
    labels: dict[str, Sequence[str]] = field(default_factory=dict)
    single: dict[str, Sequence[str]] = field(default_factory=dict)
    phrases: dict[str, Sequence[str]] = field(default_factory=dict)
    excluded: Sequence[str] = ()
    least_works: int = 5
    top_pairs: int = 25
    partial_year: int | None = None
    checked: dict[str, str] = field(default_factory=dict)
    display_names: dict[str, str] = field(default_factory=dict)


def preflight(works: DataFrame, metadata: DataFrame) -> None:
    """Raises if a table lacks columns or the tables aren't one to one by paper_id."""
    for df, needed in ((works, WORK_COLUMNS), (metadata, METADATA_COLUMNS)):
        if lacking := sorted(set(needed) - set(df.columns)):
            raise SchemaFault(f"lacks {lacking}")
    O.one_to_one(works.select("paper_id"), metadata.select("paper_id"), "paper_id")


def joined(works: DataFrame, metadata: DataFrame) -> DataFrame:
    """Works with typed metadata: citations count where the work is matched and the value isn't blank; access of unmatched works is unknown."""
    m = metadata.select("paper_id", *(F.col(c) for c in METADATA_COLUMNS[1:]))
    matched = F.col("match_status") == "MATCHED"
    got = works.join(m, "paper_id").withColumns({
        "matched": matched, "authors": F.when(matched, G.parsed_authors("authors_json")), "citations": F.when(matched, missing("cited_by_count").cast("long")),
        "access": F.when(matched, F.coalesce(F.lower(missing("oa_status")), F.lit("unknown"))).otherwise(F.lit("unknown")), "year_value": year("year"),
        "source": F.when(matched, source_key("source_id", "source_issn_l", "source_name")),
    })
    return got.withColumn("countries", F.coalesce(G.work_countries("authors"), F.array().cast("array<string>")))


def build_analysis(works: DataFrame, metadata: DataFrame, config: Config, comparisons: DataFrame | None = None) -> dict[str, DataFrame]:
    """Named tables; nothing is computed before one of them is used. Cache what joined() gives to share it among them."""
    w = joined(works, metadata)
    out: dict[str, DataFrame] = {}
    out["years"] = Q.yearly(w, F.col("year_value"), config.first_year, config.last_year, config.partial_year)
    out["access"] = Q.single_response(w, "access", ACCESS)
    for c, allowed in config.single.items():
        out[c] = Q.single_response(w, c, allowed or None)
    for c, allowed in config.labels.items():
        got = Q.multi_response(w.withColumn("__l", split_list(c)), "paper_id", "__l", list(allowed) or None, ids=True)
        out[c] = got.withColumn("display", display("label", config.display_names))
    named = w.filter("source is not null and source.key <> 'unknown'").groupBy(F.col("source.key").alias("key")).agg(F.count("*").alias("count"), F.max_by("source.display", "paper_id").alias("display"))
    out["sources"] = Q.top_and_rest(named, "key", "count", 10, "Other named").join(named.select(F.col("key").alias("label"), "display"), "label", "left")
    out["coverage"] = Q.coverage(w, {n: missing(c).isNotNull() for n, c in config.checked.items()} | {
        "abstract": missing("abstract").isNotNull(), "keywords": missing("source_keywords").isNotNull(), "year": F.col("year_value").isNotNull(), "match": F.col("matched"),
        "citations": F.col("citations").isNotNull(), "source": F.coalesce(F.col("source.key") != "unknown", F.lit(False)), "countries": F.size("countries") > 0, "authors": F.coalesce(F.size("authors") > 0, F.lit(False)), "access": F.col("access") != "unknown", "date": F.col("year_value").isNotNull(),
    })
    out["citations"] = Q.distribution(w, F.col("citations"))
    out["citations_by_year"] = Q.distribution_of_years(w, F.col("citations"), F.col("year_value"), config.first_year, config.last_year)
    out["countries"] = G.country_counts(w, "countries")
    out["countries_of_all"] = G.country_shares(w, "countries")
    out["collaboration"] = G.collaboration(w, "countries")
    links = G.identities(w.filter("matched"), "paper_id", "authors")
    out["author_links"] = links
    out["authors"] = G.productivity(links)
    out["author_bands"] = G.bands(out["authors"])
    if config.phrases:
        fields = {"title": "title", "abstract": "abstract", "keywords": "source_keywords"}
        texts = w.select("paper_id", *(phrase_text(F.coalesce(F.col(c), F.lit(""))).alias(f) for f, c in fields.items()))
        found = P.hits(texts, "paper_id", list(fields), config.phrases)
        out["phrases"] = P.frequency(found, list(fields), list(config.phrases))
        retained = found.join(works.filter(missing("abstract").isNotNull()).select("paper_id"), "paper_id", "left_semi")
        out["phrases_with_abstract"] = P.frequency(retained, list(fields), list(config.phrases))
        out["phrase_pairs"] = P.pair_table(found, "paper_id", list(config.phrases))
        out["phrase_network"] = P.network(out["phrase_pairs"], config.least_works, config.top_pairs, config.excluded)
        out["phrase_indicators"] = P.indicators(found, works, "paper_id", list(config.phrases))
    if comparisons is not None:
        out["agreement"] = A.agreement(comparisons, "reviewer_A_decision", "reviewer_B_decision")
        two = comparisons.select(A.binary("reviewer_A_decision").alias("a"), A.binary("reviewer_B_decision").alias("b"))
        out["agreement_binary"] = A.agreement(two, "a", "b")
        out["confusion"] = A.confusion(comparisons, "reviewer_A_decision", "reviewer_B_decision", ["EXCLUDE", "INCLUDE", "UNCERTAIN"])
    return out


def kept(df: DataFrame) -> DataFrame:
    """df computed once."""
    return cut(df)


def claim_register(tables: dict[str, DataFrame], bundle: str) -> DataFrame:
    """Claims of all tables that give counts by label, in the order of the labels."""
    parts = [claims(df, n, ["label"], [c for c in ("count", "value") if c in df.columns], bundle) for n, df in tables.items() if "label" in df.columns and "count" in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def displayed(counts: DataFrame, count: str = "count", denominator: str = "denominator") -> DataFrame:
    """counts with the percentage of a table (``percent_shown``) and its text in print (``percent_printed``)."""
    return counts.withColumns({"percent_shown": percent(F.col(count).cast("double"), F.col(denominator).cast("double")), "percent_printed": shown_percent(F.col(count), F.col(denominator))})


# Roles and words of versions outside journals, and matches by an exact identifier.
REPOSITORY_ROLES, EXACT_MATCHES = ("preprint", "other_version"), ("doi_exact", "openalex_id_exact")


def cohort_rules(works: DataFrame, metadata: DataFrame) -> DataFrame:
    """works with booleans journal_version and exact_match.

    journal_version is false for a family of one record whose role is a preprint or other version, or whose type names a
    preprint; exact_match is true where the metadata were matched by an exact identifier.
    """
    alone = F.col("family_size").cast("long") == 1
    apart = F.lower(strip("version_role")).isin(*REPOSITORY_ROLES) | F.lower(strip("record_type")).contains("preprint")
    exact = metadata.select("paper_id", F.lower(strip("match_method")).isin(*EXACT_MATCHES).alias("exact_match"))
    return works.withColumn("journal_version", ~(alone & apart)).join(exact, "paper_id", "left").withColumn("exact_match", F.coalesce("exact_match", F.lit(False)))


def plot_data(tables: dict[str, DataFrame], config: Config, top: int = 15) -> dict[str, DataFrame]:
    """What the figures show, each as a small table in drawing order: years, access, countries, phrases, and the network's nodes and links."""
    out = {"years": tables["years"].filter("label <> 'Missing'").select(F.col("label").cast("int").alias("x"), F.col("count").alias("y"), "partial").orderBy("x")}
    out["access"] = tables["access"].select("label", "count", "percent").orderBy(F.desc("count"), "label")
    out["countries"] = tables["countries"].orderBy(F.desc("whole"), "country").limit(top).select("country", "whole", "fractional")
    if "phrases" in tables:
        out["phrases"] = tables["phrases"].orderBy(F.desc("works"), "label").limit(top).select("label", F.col("works").alias("count"))
        e = tables["phrase_network"]
        out["network_nodes"] = P.nodes(e).orderBy("label")
        out["network_links"] = e.select("left", "right", F.col("count").alias("width")).orderBy(F.desc("width"), "left", "right")
    return out


def build_analysis_from_rows(works: DataFrame, metadata: DataFrame, config: Config, comparisons: DataFrame | None = None, selection: DataFrame | None = None) -> dict[str, DataFrame]:
    """build_analysis, with percentages as shown, the sensitivity cohorts' sizes, the selection and plot data among the tables."""
    out = build_analysis(works, metadata, config, comparisons)
    for n in [n for n, df in out.items() if {"label", "count", "denominator"} <= set(df.columns)]:
        out[n] = displayed(out[n])
    if {"family_size", "version_role", "record_type"} <= set(works.columns) and "match_method" in metadata.columns:
        marked = cohort_rules(works, metadata)
        out["cohorts"] = Q.coverage(marked, {"journal_version": F.col("journal_version"), "exact_match": F.col("exact_match")})
    if selection is not None:
        out["selection"] = selection
    return out | {f"plot_{n}": df for n, df in plot_data(out, config).items()}


def result_table(tables: dict[str, DataFrame], names: Sequence[str]) -> DataFrame:
    """Frequency tables as rows of the shared shape."""
    parts = [long_rows(tables[n].withColumnRenamed("label", "category"), "Works", n, "all works", "multi" if "work_ids" in tables[n].columns else "single") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sensitivity(works: DataFrame, metadata: DataFrame, config: Config, members: dict) -> dict[str, dict[str, DataFrame]]:
    """The analysis for each cohort of works (name to condition on the joined table)."""
    w = joined(works, metadata)
    ids = {n: w.filter(c).select("paper_id") for n, c in members.items()}
    return {n: build_analysis(works.join(i, "paper_id", "left_semi"), metadata.join(i, "paper_id", "left_semi"), config) for n, i in ids.items()}


def run_analysis(spark: SparkSession, works: DataFrame, metadata: DataFrame, config: Config, path: str, comparisons: DataFrame | None = None, inputs: dict[str, str] | None = None) -> dict:
    """Checks the inputs, computes every table and publishes the package; returns its manifest."""
    preflight(works, metadata)
    return publish(spark, build_analysis(works, metadata, config, comparisons), path, inputs)
