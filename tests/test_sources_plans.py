"""Sources, sinks, plans and streams."""

import hashlib
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import analysis, review
from corpusloom.sources import collect as C
from corpusloom.sources import sinks as K
from corpusloom.sources import tables as T
from corpusloom.streaming import hits as H


def test_csv_scans(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿id,text\r\n1,"a ""quoted"", one\nof two lines"\r\n2,\r\n'.encode())
    assert [r["text"] for r in T.csv_exact(spark, str(p), ["id", "text"]).collect()] == ['a "quoted", one\nof two lines', None]
    with pytest.raises(T.SchemaFault):
        T.csv_exact(spark, str(p), ["text", "id"])
    assert T.csv_any(spark, str(p), ["id"]).columns == ["id", "text"]
    with pytest.raises(T.SchemaFault):
        T.csv_any(spark, str(p), ["more"])
    (tmp_path / "b.csv").write_text("a,a\n1,2\n")
    with pytest.raises(T.SchemaFault):
        T.csv_any(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception):
        T.csv_exact(spark, str(tmp_path / "c.csv"), ["a", "b"]).collect()


def test_jsonl_documents_and_pins(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    df = T.jsonl(spark, str(p), "a long")
    assert [r["a"] for r in df.collect()] == [1, 2]
    sha = hashlib.sha256(p.read_bytes()).hexdigest()
    assert T.pinned(spark, str(p), df, sha, p.stat().st_size, 2, ["a"]).count() == 2
    with pytest.raises(T.SchemaFault, match="digest, number of rows"):
        T.pinned(spark, str(p), df, "0" * 64, rows=3)
    p.write_text("[1]\n")
    with pytest.raises(Exception):
        T.jsonl(spark, str(p), "a long").collect()
    (tmp_path / "d.json").write_text('{"a": {"b": 1}}')
    d = T.json_document(spark, str(tmp_path / "d.json"))
    assert T.at_path(d, "a.b") == 1 and T.unmet(d, {"a.b": 2, "a.c": None}) == ["a.b"]


def test_batches_cover_the_master(spark):
    master = spark.createDataFrame([(f"p{i}", i) for i in range(6)], "id string, n long")
    good = spark.createDataFrame([(f"p{i}", i // 3, i % 3) for i in range(6)], "id string, b int, n int")
    assert T.batch_faults(good, master, "id", "b", "n").count() == 0
    bad = spark.createDataFrame([("p0", 0, 0), ("p0", 0, 1), ("p2", 0, 2), ("p1", 1, 0), ("p9", 1, 1), ("p4", 1, 2), ("p5", 1, 3)], "id string, b int, n int")
    assert {(r["id"], r["fault"]) for r in T.batch_faults(bad, master, "id", "b", "n").collect()} == {("p0", "repeated"), ("p3", "missing"), ("p9", "not in master"), ("p2", "out of order")}


def test_xml_and_redaction(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><Article><id>1</id></Article><Article><id>2</id></Article></r>")
    assert sorted(r["id"] for r in T.xml_records(spark, str(tmp_path / "a.xml"), "Article", "id long").collect()) == [1, 2]
    df = spark.createDataFrame([({"API_KEY": "x", "q": "y", "token": ""},)], "m map<string,string>")
    assert T.redacted(df, "m", ["api_key", "token"]).first()["m"] == {"API_KEY": "<present:redacted>", "q": "y", "token": ""}


def test_retry_after():
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)
    assert C.retry_after("7") == 7 and C.retry_after("Thu, 01 Jan 2026 00:00:10 GMT", now) == 10 and C.retry_after("2026-01-01T00:00:05Z", now) == 5 and C.retry_after("soon") is None
    assert C.pause(0, None) == 0.25 and C.pause(20, None) == 30 and C.pause(0, 99) == 30 and C.pause(0, 0) == 0.25


def replies(style, total, size=2):
    def send(request):
        at = {"cursor": lambda r: 0 if r["cursor"] == "*" else int(r["cursor"]), "offset": lambda r: r["cursor"], "page": lambda r: (r["cursor"] - 1) * size, "token": lambda r: int(r.get("cursor", 0))}[style](request)
        batch = [{"id": i} for i in range(at, min(total, at + request["per_page"]))]
        after = at + len(batch)
        return C.Reply(200, {"meta": {"n": total, "next": str(after) if after < total else None}, "items": batch})

    return send


@pytest.mark.parametrize("style", ["cursor", "offset", "page", "token"])
def test_paging(style):
    s = C.Service("x", style, "items", next="meta.next", total="meta.n", key="id", page_size=2, stable_total=True)
    assert [r["id"] for p in C.pages(s, {}, replies(style, 5)) for r in p] == [0, 1, 2, 3, 4]
    from dataclasses import replace

    assert sum(len(p) for p in C.pages(replace(s, cap=3), {}, replies(style, 5))) == 3
    with pytest.raises(ValueError):
        s.lowered(3)


def test_troubles():
    waits, answers = [], [C.Reply(503, None, {"Retry-After": "2"}), C.Reply(429, None), C.Reply(200, {"items": []})]
    assert C.fetch(lambda r: answers.pop(0), {}, sleep=waits.append).status == 200 and waits == [2, 0.5]
    with pytest.raises(RuntimeError, match="404"):
        C.fetch(lambda r: C.Reply(404, None), {}, sleep=waits.append)
    s = C.Service("x", "offset", "items", key="id", page_size=1)
    with pytest.raises(RuntimeError, match="twice"):
        list(C.pages(s, {}, lambda r: C.Reply(200, {"items": [{"id": 1}]})))


def test_collecting(spark):
    s = C.Service("svc", "offset", "items", total="meta.n", page_size=2)
    got = C.collect(spark, s, [("q1", {}), ("q2", {})], replies("offset", 3), "2026-01-01T00:00:00Z").collect()
    assert sorted((r["query_id"], r["record_ordinal"], json.loads(r["raw_record"])["id"]) for r in got) == [(q, i, i) for q in ("q1", "q2") for i in range(3)]


def test_package(spark, tmp_path):
    df = spark.createDataFrame([(1, True, None, ["a"], {"k": 1})], "id long, b boolean, s string, l array<string>, m map<string,int>")
    assert tuple(K.flat_text(df).first()) == ("1", "true", "", '["a"]', '{"k":1}')
    K.write_pair(df, str(tmp_path / "t"))
    with pytest.raises(Exception):
        K.write_csv(df, str(tmp_path / "t.csv"))
    path = str(tmp_path / "pkg")
    m = K.publish(spark, {"a": df.select("id")}, path)
    assert m["tables"] == ["a"] and spark.read.parquet(f"{path}/tables/a").count() == 1 and json.load(open(f"{path}/FROZEN.json"))["ledger_sha256"] == m["ledger_sha256"]
    with pytest.raises(FileExistsError):
        K.publish(spark, {"a": df.select("id")}, path)
    src = tmp_path / "in.txt"
    src.write_text("x")
    with pytest.raises(ValueError, match="changed"):
        K.publish(spark, {"a": df.select("id")}, str(tmp_path / "p2"), {str(src): "0"})
    assert not (tmp_path / "p2").exists() and not (tmp_path / "p2.building").exists()


def test_ledger(spark):
    led = spark.createDataFrame([("a", 1, "x"), ("b", 2, "Y"), ("c", 3, "z"), ("c", 3, "z")], "path string, bytes long, sha256 string")
    seen = spark.createDataFrame([("a", 1, "q"), ("b", 2, "y"), ("d", 1, "w")], "path string, bytes long, sha256 string")
    assert {tuple(r) for r in K.ledger_faults(led, seen, ["e"]).collect()} == {("a", "digest"), ("c", "missing"), ("c", "repeated"), ("d", "not in ledger"), ("e", "required")}


WORKS = [
    ("w1", "Large language model virtual patient training", "Communication skills in a virtual patient.", "clinical reasoning", "2023", "GPT-4", "virtual_patient", "communication"),
    ("w2", "Generative AI for learners", "Generative AI in nursing education with teamwork.", "", "2024", "unspecified_generative_model", "scenario", "teamwork"),
    ("w3", "Large language model clinical reasoning", "", "assessment", "2025", "ChatGPT_unspecified", "", ""),
    ("w4", "Surgical education chatbot", "A chatbot for role play.", "virtual patient", "2026", "GPT-4;Claude", "roleplay", ""),
]
META = [
    ("w1", "MATCHED", "gold", "0", [dict(author_id="A1", author_name="Ann", countries=["US", "GB"])], "S1", "Journal 1", "0000-0001"),
    ("w2", "MATCHED", "closed", "1", [dict(author_id="A1", author_name="Ann", countries=["US"]), dict(author_name="Bob", countries=["CA"])], "S1", "Journal 1", "0000-0001"),
    ("w3", "UNMATCHED", "", "", [], "", "", ""),
    ("w4", "MATCHED", "green", "3", [dict(author_id="A2", author_name="Cy", countries=["AU"])], "S2", "Journal 2", "0000-0002"),
]
CONFIG = analysis.Config(2023, 2026, labels={"final_model_families": (), "final_simulation_modalities": ("virtual_patient", "scenario", "roleplay", "osce")}, phrases={"large language model": ["large language model"], "virtual patient": ["virtual patient"], "nothing": ["no such phrase"]}, least_works=1, partial_year=2026)


@pytest.fixture
def fixture(spark):
    works = spark.createDataFrame(WORKS, "paper_id string, title string, abstract string, source_keywords string, year string, final_model_families string, final_simulation_modalities string, final_nts_domains string")
    meta = spark.createDataFrame([(*m[:4], json.dumps(m[4]), *m[5:]) for m in META], "paper_id string, match_status string, oa_status string, cited_by_count string, authors_json string, source_id string, source_name string, source_issn_l string")
    return works, meta


def test_analysis_of_four_works(spark, fixture, tmp_path):
    comps = spark.createDataFrame([("INCLUDE", "INCLUDE"), ("EXCLUDE", "EXCLUDE"), ("INCLUDE", "EXCLUDE"), ("UNCERTAIN", "EXCLUDE"), ("INCLUDE", "INCLUDE"), ("INCLUDE", "INCLUDE")], "reviewer_A_decision string, reviewer_B_decision string")
    t = analysis.build_analysis(*fixture, CONFIG, comps)
    at = lambda n, key="label", v="count": {r[key]: r[v] for r in t[n].collect()}
    assert len(at("access")) == 7 and at("access")["unknown"] == 1 and at("access")["diamond"] == 0
    assert at("years") == {"2023": 1, "2024": 1, "2025": 1, "2026": 1, "Missing": 0}
    assert at("final_model_families")["GPT-4"] == 2 and at("final_simulation_modalities")["osce"] == 0
    assert all(r["present"] + r["missing"] == 4 for r in t["coverage"].collect())
    assert tuple(t["collaboration"].first()) == (2, 3, 4)
    p = {r["label"]: r for r in t["phrases"].collect()}
    assert (p["large language model"]["works"], p["large language model"]["title"]) == (2, 2) and p["nothing"]["works"] == 0
    assert {r["label"]: r["works"] for r in t["phrases_with_abstract"].collect()}["large language model"] == 1
    assert at("authors", "identity", "works")["openalex:a1"] == 2
    d = t["citations"].first()
    assert (d["n"], d["sum"], d["zero_count"]) == (3, 4, 1)
    assert t["agreement"].first()["agreed"] == 4 and at("sources")["id:S1"] == 2
    assert sum(r["fractional"] for r in t["countries"].collect()) == pytest.approx(3)
    table = analysis.result_table(t, ["access", "final_model_families"])
    assert table.filter("denominator is null").count() == 0 and table.count() == 11
    s = analysis.sensitivity(*fixture, CONFIG, {"matched": F.col("matched")})
    assert s["matched"]["access"].agg(F.sum("count")).first()[0] == 3
    m = analysis.run_analysis(spark, *fixture, CONFIG, str(tmp_path / "out"))
    assert "phrase_pairs" in m["tables"]
    with pytest.raises(ValueError):
        analysis.preflight(fixture[0], fixture[1].limit(3))
    with pytest.raises(T.SchemaFault):
        analysis.preflight(fixture[0].drop("title"), fixture[1])


def test_from_records_to_works(spark):
    recs = spark.createDataFrame([("p1", "A language model", "nurse training", ["simulation"]), ("p2", "A language model", "nurse", ["x"]), ("p3", "", None, None)], "paper_id string, title string, abstract string, keywords array<string>")
    got = review.build_screening_candidates(recs, {"lm": r"\blanguage\s+models?\b", "sim": r"\bsimulat\w*\b"})
    assert [r["paper_id"] for r in got["candidates"].collect()] == ["p1"] and got["outside"].count() == 2 and "batch" in got["blinded"].columns
    members = spark.createDataFrame([("p1", "f", True), ("p2", "f", False)], "paper_id string, provisional_family_id string, preferred boolean")
    pairs = spark.createDataFrame([("p1", "p2", True)], "left string, right string, same boolean")
    fin = review.finalize_consolidation(members, pairs)
    assert fin["works"].count() == 1 and fin["faults"].count() == 0
    works = spark.createDataFrame([("p1", "10.1/a", "2020", "2020-01-01"), ("p2", "10.1/b", "2021", "2021-01-01")], "paper_id string, doi string, year string, publication_date string")
    fix = spark.createDataFrame([("p2", "doi", "10.1/b", "10.1/A"), ("p1", "year", "2020", "2022")], "paper_id string, field string, expected_old string, new_value string")
    c = review.apply_corrections(works, fix, ["doi", "year"])
    assert {r["fault"] for r in c["faults"].collect()} == {"shared DOI: 10.1/a", "year and date differ: p1"}
    assert all(r["sha256_before"] != r["sha256_after"] for r in c["ledger"].collect())
    both = review.integrate(works.withColumn("version_family_id", F.col("paper_id")), works.select("paper_id").withColumn("version_family_id", F.lit("g")))
    assert both["rows"].count() == 4 and {r["source_corpus"]: r["families"] for r in both["counts"].collect()} == {"base": 2, "increment": 1}
    b = review.prepare_extraction_batches(works, 1)
    assert sorted(r["batch"] for r in b.collect()) == [1, 2]


def test_audit(spark):
    comp = spark.createDataFrame([(f"c{i}", i % 9 == 0, i % 4 == 0, i % 5 == 0, i % 7 == 0, i % 11 == 0) for i in range(400)], "paper_id string, missing boolean, uncertain boolean, disagree boolean, agreed_include boolean, agreed_exclude boolean")
    outside = spark.createDataFrame([(f"o{i}", "ABC"[i % 3]) for i in range(60)], "paper_id string, pool string")
    target = {"difficult": 40, "include": 20, "exclude": 20, "boundary": 20}
    s = review.build_human_audit_package(comp, outside, "seed", {"A": 10, "B": 5, "C": 5}, target)
    got = s.collect()
    assert len(got) == 100 and sorted(r["audit_id"] for r in got)[0] == "H001" and {g: sum(r["sample_group"] == g for r in got) for g in target} == target
    answers = s.select("audit_id", F.when(F.col("audit_order") % 10 == 0, "UNCERTAIN").otherwise("INCLUDE").alias("human_decision"))
    fin = review.finalize_human_audit(s, answers, comp.select("paper_id", F.lit("INCLUDE").alias("final_decision")))
    whole = {r["sample_group"]: r["n"] for r in fin["strata"].filter("component = 'ALL'").collect()}
    assert whole == target and fin["second_review"].count() >= 10


def test_streams(spark, tmp_path):
    row = lambda s, i, t: json.dumps({"schema_version": "1", "source": s, "query_id": "q", "record_ordinal": 0, "retrieved_at_utc": t, "request_id": "r", "raw_format": "json", "raw_record": json.dumps({"id": i})})
    folder = tmp_path / "hits"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join([row("a", 1, "2026-01-01T00:00:00Z"), row("a", 1, "2026-01-01T00:01:00Z"), row("b", 1, "2026-01-01T00:11:00Z")]))
    hits = H.read_hits(spark, str(folder))
    q = H.first_hits(hits, "$.id").writeStream.format("memory").queryName("first_hits").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first_hits").count() == 2
    q = H.arrivals(hits).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["source"], r["hits"]) for r in spark.table("arrivals").collect()) == [("a", 2), ("b", 1)]
