"""Labels and vocabularies."""

from pyspark.sql import functions as F

from corpusloom.functions import labels as B
from corpusloom.functions.text import coded, display
from corpusloom.operators import frequency as Q
from corpusloom.operators import screening as S


def test_display(spark):
    df = spark.createDataFrame([("vr_ar_xr",), ("GPT-4",), ("some_label",)], "x string")
    assert [r[0] for r in df.select(display("x", B.DISPLAY)).collect()] == ["Virtual, augmented or extended reality", "GPT-4", "Some label"]
    assert spark.createDataFrame([("us",)], "x string").select(coded("x", B.COUNTRIES)).first()[0] == "United States (US)"


def test_domains(spark):
    texts = [("ChatGPT for nursing students", "A simulation study"), ("ChatGPT for nursing students", "A survey"), ("ChatGPT in hospital simulation", None), ("GPT-4 trainees in role-play", ""), ("nursing student simulation", "")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id long, title string, abstract string")
    assert [r["id"] for r in S.candidates(df, ["title", "abstract"], B.DOMAINS).collect()] == [0]
    got = {r["id"]: r["pool"] for r in S.near_misses(df, ["title", "abstract"], B.DOMAINS, "language_model", B.BOUNDARY_POOLS).collect()}
    assert got == {1: "BOUNDARY_NO_SIM", 2: "BOUNDARY_NO_ED", 3: "BOUNDARY_NO_HEALTH"}


def test_specialties(spark):
    df = spark.createDataFrame([("urology", 3), ("surgery teaching", 2), ("medicine", 9), ("nursing", 5), ("dentistry", 5), ("pharmacy", 1)], "k string, n long")
    got = {r["k"]: (r["group"], r["place"], r["shown"]) for r in Q.grouped_labels(df, "k", "n", B.SPECIALTY_GROUPS, B.OTHER_SPECIALTIES, 1).collect()}
    assert got["urology"][0] == got["surgery teaching"][0] == "surgical specialty" and got["medicine"] == ("general or multi-professional", 1, True)
    assert got["dentistry"] == (B.OTHER_SPECIALTIES, 1, True) and got["nursing"] == (B.OTHER_SPECIALTIES, 2, False)


def test_vocabularies(spark, tmp_path):
    doc = {"p": {"dictionary": [{"group": "scope_check", "label": "a", "variants": ["a", "as"]}, {"group": "x", "label": "b", "variants": ["b"]}]}}
    assert B.phrase_dictionary(doc, "p.dictionary") == ({"a": ["a", "as"], "b": ["b"]}, ["a"])
    (tmp_path / "t.csv").write_text("concept_id,domain,concept_label,variants\nc1,d,C,one|two words\n")
    concepts, rest = B.thesaurus(spark, str(tmp_path / "t.csv"))
    assert concepts == {"c1": ["one", "two words"]} and rest.agg(F.count("*")).first()[0] == 1
