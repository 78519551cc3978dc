"""Contracts, the production run, and what validates its package."""

import csv
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import overlay as O
from corpusloom.operators import sampling as M
from corpusloom.operators import screening as S
from corpusloom.plans import analysis, contracts
from corpusloom.sources import collect as C
from corpusloom.sources import sinks as K
from corpusloom.sources import tables as T

from .test_sources_plans import CONFIG, META, WORKS

SELECTION = [
    *(("retrievals", s, 10) for s in contracts.SOURCES), ("retrievals", "total", 60), ("cutoff", "total", 2), ("after_cutoff", "total", 58),
    *(("date_status", s, 10) for s in contracts.DATE_STATUSES), ("automatic_merges", "doi", 7), ("automatic_merges", "title", 1), ("automatic_merges", "total", 8), ("after_automatic", "total", 50),
    ("reviewed_merges", "one", 5), ("reviewed_merges", "total", 5), ("deduplicated", "total", 45), ("candidates", "a", 10), ("candidates", "b", 5), ("candidates", "total", 15), ("outside", "total", 30),
    ("resolution", "x", 3), ("resolution", "total", 3), ("out_of_range", "total", 1), ("included", "total", 6), ("excluded", "total", 9), ("works", "total", 4),
]


def faults(spark, rows, **how):
    return {r["rule"]: r["amount"] for r in contracts.selection_faults(spark.createDataFrame(rows, "group string, part string, count long"), **how).collect()}


def test_selection(spark):
    assert faults(spark, SELECTION) == {}
    put = lambda g, p, n: [(a, b, n if (a, b) == (g, p) else c) for a, b, c in SELECTION]
    assert faults(spark, put("retrievals", "doaj", 11)) == {"sources sum to all retrievals": 1, "date statuses sum to the other sources": -1}
    assert faults(spark, put("cutoff", "total", 11)) == {"cutoff within its source": 1, "retrievals less the cutoff": -9}
    assert faults(spark, put("works", "total", 7)) == {"works within the included records": 1}
    assert faults(spark, put("out_of_range", "total", -1)) == {"not a count: out_of_range/total": -1}
    assert set(faults(spark, [*SELECTION, SELECTION[0]])) == {"given twice: retrievals/openalex", "sources sum to all retrievals", "date statuses sum to the other sources"}
    assert "unknown part: date_status/later" in faults(spark, [*SELECTION, ("date_status", "later", 0)])
    assert "lacks a part: retrievals/doaj" in faults(spark, [r for r in SELECTION if r[1] != "doaj"])
    open_ = [r for r in SELECTION if r[0] not in contracts.FINAL]
    assert faults(spark, open_, final=False) == {} and set(faults(spark, open_)) == {"lacks a count: decisions sum to the candidates", "lacks a count: works within the included records"}


def written(path, columns, rows):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([columns, *rows])
    return contracts.Pin(str(path), hashlib.sha256(open(path, "rb").read()).hexdigest(), len(rows), os.path.getsize(path), columns)


@pytest.fixture
def production(tmp_path):
    works = written(tmp_path / "works.csv", ["paper_id", "title", "abstract", "source_keywords", "year", "final_model_families", "final_simulation_modalities", "final_nts_domains", "family_size", "version_role", "record_type"], [[*w, "1", "preprint" if i == 1 else "final_journal_article", ""] for i, w in enumerate(WORKS)])
    meta = written(tmp_path / "meta.csv", ["paper_id", "match_status", "oa_status", "cited_by_count", "authors_json", "source_id", "source_name", "source_issn_l", "match_method"], [[*m[:4], json.dumps(m[4]), *m[5:], "doi_exact" if i else "title"] for i, m in enumerate(META)])
    checked = {"models": "final_model_families", "methods": "final_simulation_modalities", "skills": "final_nts_domains", "specialty": "title", "design": "title"}
    config = analysis.Config(2023, 2026, labels=CONFIG.labels, phrases=CONFIG.phrases, least_works=1, checked=checked)
    return contracts.Production({"works": works, "metadata": meta}, SELECTION, config)


def unchecked(path):
    """Takes away the checksum that Hadoop keeps beside a file, which would notice the change first."""
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


def test_production_and_its_package(spark, production, tmp_path):
    path = str(tmp_path / "package")
    manifest = contracts.run_production(spark, production, path)
    assert set(contracts.REQUIRED) <= set(manifest["tables"]) and "selection" in manifest["tables"]
    assert contracts.validate_package(spark, path).count() == 0
    read = lambda n: spark.read.parquet(f"{path}/tables/{n}")
    assert {r["measure"] for r in read("coverage").collect()} >= set(contracts.COVERAGE)
    assert read("claims").filter("reported_value is null").count() == 0
    part = next(os.path.join(f"{path}/tables/years", f) for f in os.listdir(f"{path}/tables/years") if f.endswith(".parquet"))
    with open(part, "ab") as f:
        f.write(b"x")
    unchecked(part)
    assert {r["fault"] for r in contracts.validate_package(spark, path).collect()} == {"size"}
    with open(f"{path}/FROZEN.json", "w") as f:
        json.dump({"ledger_sha256": "0"}, f)
    unchecked(f"{path}/FROZEN.json")
    assert ("FROZEN.json", "digest of the ledger") in {tuple(r) for r in contracts.validate_package(spark, path).collect()}


def test_broken_contracts_publish_nothing(spark, production, tmp_path):
    path = str(tmp_path / "package")
    change = lambda **x: contracts.Production(**({k: getattr(production, k) for k in ("pins", "selection", "config", "required", "coverage")} | x))
    for bad, why in (
        (change(selection=[(g, p, n + 1 if g == "outside" else n) for g, p, n in SELECTION]), "outside the frame"),
        (change(selection=[(g, p, 3 if g == "works" else n) for g, p, n in SELECTION]), "as many as the selection"),
        (change(coverage=[*contracts.COVERAGE, "mood"]), "coverage is absent"),
        (change(required=[*contracts.REQUIRED, "absent"]), "table is absent"),
    ):
        with pytest.raises(contracts.ContractFault, match=why):
            contracts.run_production(spark, bad, path)
    with open(production.pins["works"].path, "a") as f:
        f.write("\n")
    with pytest.raises(T.SchemaFault, match="digest"):
        contracts.run_production(spark, production, path)
    assert not os.path.exists(path)


def test_analysis_contract(spark):
    works = spark.range(4)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "coverage": frame([("date", 3, 1, 4), ("date", 3, 2, 4)], "measure string, present long, missing long, denominator long"),
        "access": frame([("gold", 3, 4)], "label string, count long, denominator long"),
        "countries": frame([("US", 1, 2.0, 2), ("GB", 1, None, 2)], "country string, whole long, fractional double, covered long"),
        "author_links": frame([("w", "a"), ("v", "a"), ("w", " ")], "work string, identity string"),
        "authors": frame([("a", 1), ("b", 1)], "identity string, works long"),
        "author_bands": frame([("1", 1)], "band string, identities long"),
        "phrases": frame([("p", 2, 3, 0)], "label string, works long, title long, abstract long"),
        "phrase_network": frame([("p", "q", 1, 3, 1)], "left string, right string, count long, left_works long, right_works long"),
        "claims": frame([("c:1", "no")], "claim_id string, bundle_sha256 string"),
        "word_cloud_of_all": works,
    }
    got = {(r["rule"], r["detail"]) for r in contracts.analysis_faults(tables, works, required=["claims", "years"], coverage=["date", "design"]).collect()}
    assert got >= {
        ("table is absent", "years"), ("prohibited table", "word_cloud_of_all"), ("coverage doesn't sum to all works", "date"), ("coverage is absent", "design"), ("coverage given twice", "date"),
        ("access don't sum to all works", "3"), ("access category is absent", "green"), ("country without both counts", "GB"), ("country without both counts", "US"), ("author ledgers differ", "a"), ("author ledgers differ", "b"),
        ("author without key", "w"), ("bands don't sum to all authors", "1"), ("node size isn't the phrase's count", "p"), ("node size isn't the phrase's count", "q"), ("phrases: count by field is absent", "keywords"),
        ("phrases: more works in a field than at all", "p"), ("claim without a bound input", "c:1"),
    }


def test_displayed_tables_cohorts_and_plots(spark, production):
    works, meta = (T.csv_any(spark, production.pins[r].path, []) for r in ("works", "metadata"))
    t = analysis.build_analysis_from_rows(works, meta, production.config)
    assert {r["label"]: (r["percent_shown"], r["percent_printed"]) for r in t["access"].collect()}["gold"] == (25.0, "25.0")
    assert {r["measure"]: r["present"] for r in t["cohorts"].collect()} == {"journal_version": 3, "exact_match": 3}
    assert [r["x"] for r in t["plot_years"].collect()] == [2023, 2024, 2025, 2026] and t["plot_network_nodes"].count() == 2
    assert t["citations_by_year"].count() == 4 and t["countries_of_all"].filter("country is null").first()["whole"] == 1


def test_services():
    assert len(C.SERVICES) == 8 and C.SERVICES["scopus"].stable_total
    with pytest.raises(ValueError):
        C.SERVICES["core"].lowered(101)
    many = lambda r: C.Reply(200, {"search-results": {"opensearch:totalResults": 5001, "entry": [{"eid": r.get("start")}]}})
    with pytest.raises(RuntimeError, match="5001 records, of which the service gives 5000"):
        list(C.pages(C.SERVICES["scopus"], {}, many))
    assert C.preflight_counts(C.SERVICES["scopus"], [("q", {})], many) == {"q": 5001}
    xml = "<s>" + "".join(f"<PubmedArticle><i>{i}</i></PubmedArticle>" for i in range(3)) + "<PubmedBookArticle a='b'>x</PubmedBookArticle ></s>"

    def send(r):
        return C.Reply(200, {"esearchresult": {"webenv": "W", "querykey": "1", "count": "4"}}) if r.get("usehistory") else C.Reply(200, xml if r["retstart"] == 0 and r["WebEnv"] == "W" else "<s/>")

    q = C.pubmed_query({"term": "x"}, send)
    got = [x for page in C.pages(C.SERVICES["pubmed"], q, C.pubmed_reply(q, send)) for x in page]
    assert len(got) == 4 and got[0] == "<PubmedArticle><i>0</i></PubmedArticle>" and got[3].startswith("<PubmedBookArticle a")


def test_pairs_of_files_keep_their_contract(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id long, x string")
    for how, why in (({"columns": ["x", "id"]}, "columns"), ({"key": ["id"]}, "key given twice")):
        with pytest.raises(ValueError, match=why):
            K.write_pair(df, str(tmp_path / "t"), **how)
    assert not (tmp_path / "t.csv").exists()
    K.write_pair(df.withColumn("r", F.rand()), str(tmp_path / "t"), ["id", "x", "r"], ["id", "x"])
    rows = sorted((r["x"], float(r["r"])) for r in spark.read.option("header", True).csv(str(tmp_path / "t.csv")).collect())
    assert rows == sorted((r["x"], r["r"]) for r in spark.read.json(str(tmp_path / "t.json")).collect())


def test_places_and_merges(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, place long")
    with pytest.raises(ValueError, match="order"):
        O.one_to_one(a, a.withColumn("place", 3 - F.col("place")), "id", "place")
    before = spark.createDataFrame([(1, "f1", "x"), (2, "f2", "y"), (3, "f3", "z")], "id long, fam string, t string")
    after = spark.createDataFrame([(1, "f1", "x"), (2, "f1", "Y"), (4, "f4", "n")], "id long, fam string, t string")
    got = {(r["id"], r["field"], r["fault"]) for r in O.merge_faults(before, after, "id", "fam", ["fam", "t"], ["fam"]).collect()}
    assert got == {(2, "t", "field that must stay"), (3, "fam", "record lost"), (3, "t", "record lost"), (4, "fam", "record added"), (4, "t", "record added")}


def test_boundary_pools_open(spark):
    ranked = spark.range(1, 61).select(F.lit("BOUNDARY_NO_ED").alias("pool"), F.col("id"), F.col("id").cast("int").alias("pool_rank"))
    audited = spark.createDataFrame([(1, "D", "BOUNDARY_NO_ED", False, True, "UNCERTAIN"), (2, "D", "BOUNDARY_NO_ED", False, False, "")], "id long, sample_group string, sample_component string, confirmed_error boolean, second_review boolean, second_decision string")
    assert sorted(r["id"] for r in M.audit_expansion(ranked, audited, "id").collect()) == list(range(3, 51))
    assert M.audit_expansion(ranked, audited.filter("id = 2"), "id").count() == 0


def test_minutes_and_markers(spark):
    df = spark.createDataFrame([(1, "x", "said so"), (2, "-1", ""), (3, "nan", None), (4, None, "KIND"), (5, "0", "KIND")], "id long, m string, why string")
    got = S.violations(df, S.minutes_rules("m") | S.marker_rules("why", {"kind": (F.col("id") > 2, "KIND")}), ["id"]).collect()
    assert {tuple(r) for r in got} == {(1, "m: not a finite number"), (2, "m: negative"), (3, "m: not a finite number"), (3, "kind")}
