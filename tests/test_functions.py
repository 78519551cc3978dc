"""Functions against plain Python and published values."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import numbers as N
from corpusloom.functions import text as T
from corpusloom.operators import agreement as A


def values(spark, items, *columns):
    df = spark.createDataFrame([(x,) for x in items], "x string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_normalisers(spark):
    got = values(spark, [" a b ", None, "01", "7", "-3"], T.strip("x"), T.exact_integer("x", 0))
    assert got == [("a b", None), ("", None), ("01", None), ("7", 7), ("-3", None)]
    assert values(spark, ["HTTPS://doi.org/10.1/A.", "doi:10.2/b", None], T.doi("x")) == [("10.1/a",), ("10.2/b",), ("",)]
    assert values(spark, ["Straße Élan-Vital!"], T.linking_text("x"), T.thesaurus_text("x")) == [("strasse elan vital", "stra e lan vital")]
    assert values(spark, ["2026-02-30T00:00:00Z", "2026-02-03T04:05:06Z"], T.utc_time("x").isNull()) == [(True,), (False,)]
    assert values(spark, ["a; ;b", "a;b;a", "a;b", ""], T.list_faults("x")) == [("blank item",), ("repeated item",), (None,), (None,)]
    assert values(spark, ["GPT-4_turbo", "virtual_patient"], T.display("x", {"virtual_patient": "VP"})) == [("GPT-4 turbo",), ("VP",)]
    assert values(spark, ["gb", "zz"], T.coded("x", {"GB": "United Kingdom"})) == [("United Kingdom (GB)",), ("ZZ",)]
    df = spark.createDataFrame([(["b", "A ", "a", "B", None, " c"],)], "x array<string>")
    assert df.select(T.unique_texts("x"), T.first_spellings("x")).first() == (["A", "b", "c"], ["b", "A", "c"])


def test_phrases_across_fields_and_hyphens(spark):
    p = T.phrase_pattern(["virtual patient", "VP"])
    got = values(spark, ["virtual\npatient", "virtual–patient", "virtual patients", "évirtual patient", "a VP."], F.col("x").rlike(p))
    assert [g[0] for g in got] == [True, True, False, False, True]


def test_percent_follows_the_binary_value(spark):
    cases = [(1, 400), (7, 2000), (1, 3919), (0, 10), (1, 2000)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in cases], "a double, b double")
    assert [r[0] for r in df.select(N.percent("a", "b")).collect()] == [N.percent_value(a, b) for a, b in cases]
    assert N.percent_value(1, 400) == 0.2 and N.percent_value(1, 3919) == pytest.approx(100 / 3919) and N.percent_value(1, 0) is None
    shown = spark.createDataFrame([(x,) for x in (1, 3, 4, 0)], "c long").select(N.shown_percent(F.col("c"), F.lit(3919))).collect()
    assert [r[0] for r in shown] == ["<0.1%", "<0.1%", "0.1", "0.0"]


def test_exact_intervals():
    # published values
    for k, n, lo, hi in ((85, 100, 0.7646924998510451, 0.9135456143583514), (7, 40, 0.07338272935208517, 0.3277901333615859), (38, 80, 0.36213358167715237, 0.5897721586232294), (0, 20, 0, 0.16843347098308536)):
        assert N.clopper_pearson(k, n) == pytest.approx((lo, hi), abs=1e-9)


@given(st.integers(1, 60), st.data())
def test_interval_holds_the_share(n, data):
    k = data.draw(st.integers(0, n))
    lo, hi = N.clopper_pearson(k, n)
    assert 0 <= lo <= k / n <= hi <= 1


PUBLISHED = np.array([[2895, 20, 37], [457, 463, 14], [13, 10, 10]])


def test_published_agreement(spark):
    names = ["EXCLUDE", "INCLUDE", "UNCERTAIN"]
    raw, k = N.kappa(PUBLISHED)
    assert raw == pytest.approx(3368 / 3919) and k == pytest.approx(0.564871964, abs=1e-9)
    rows = [(names[i], names[j]) for i in range(3) for j in range(3) for _ in range(PUBLISHED[i, j])]
    df = spark.createDataFrame(rows, "a string, b string")
    got = A.agreement(df, "a", "b").first()
    assert got["n"] == 3919 and got["agreed"] == 3368 and got["kappa"] == pytest.approx(k, abs=1e-12)
    assert (A.matrix(df, "a", "b", names) == PUBLISHED).all()
    two = df.select(A.binary("a").alias("a"), A.binary("b").alias("b"))
    assert A.agreement(two, "a", "b").first()["kappa"] == pytest.approx(0.579701675, abs=1e-9)
    ci = A.kappa_interval(df, "a", "b", names, replicates=1000).first()
    assert ci["lower"] == pytest.approx(0.5343, abs=0.01) and ci["upper"] == pytest.approx(0.5945, abs=0.01)
    drawn = N.multinomial_bootstrap(PUBLISHED)
    assert drawn == pytest.approx((0.5343, 0.5945), abs=0.01)


def test_certain_agreement(spark):
    df = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    assert A.agreement(df, "x", "y").first()["kappa"] is None
    assert A.agreement(df, "x", "y", certain=True).first()["kappa"] == 1.0
    assert A.agreement(df.limit(0), "x", "y").first()["kappa"] is None


def test_paired_bootstrap_in_chunks():
    m = np.array([[60, 7], [0, 33]])
    cells = np.repeat(np.arange(4), m.reshape(-1))
    want = N.paired_bootstrap(cells, 2, 500, 9)
    assert [N.paired_table_bootstrap(m, 500, 9, k) for k in (10_000, 700, 100, 30)] == [want] * 4


def test_paired_records_over_a_million(spark):
    from corpusloom.operators.agreement import kappa_interval

    m = np.array([[600_001, 70_000], [30_000, 330_000]])
    df = spark.range(int(m.sum())).selectExpr(f"if(id < {m[0].sum()}, 'a', 'b') as x", f"if(id < {m[0, 0]} or id between {m[0].sum()} and {m[0].sum() + m[1, 0] - 1}, 'a', 'b') as y")
    r = kappa_interval(df, "x", "y", ["a", "b"], replicates=40).first()
    want = N.paired_bootstrap(np.repeat(np.arange(4), m.reshape(-1)), 2, 40, at_once=3)
    assert (r["n"], r["unit"], r["lower"], r["upper"]) == (int(m.sum()), "paired record", *want)
    assert want != N.multinomial_bootstrap(m, 40)


def test_texts_that_the_jvm_folds_agree_with_python(spark):
    import html
    import re
    import unicodedata

    texts = ["", "Plain TEXT 12", "ÀÉÎÕÜ Það Ñandú ÿ Øre Æ", "Straße ẞ", "a &amp; <b>B</b> &lt;", "½ ﬁ ª µ × ÷ \u00a0x", "e\u0301 É", "İ ı K Å", "Ω ά ς", "日本 １２", None, "tab\tand\nline \x1f\x7f", "Ǆ ŉ ǰ", "end\u0085", "end\n", "\u2028"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", T.casefold("t").alias("c"), T.nfkc("t").alias("n"), T.linking_text("t").alias("l"), T.phrase_text("t").alias("p")).orderBy("i").collect()
    for r, t in zip(got, texts):
        t = t or ""
        assert r["c"] == t.casefold() and r["n"] == unicodedata.normalize("NFKC", t) and r["l"] == T.fold_plain(t), t
        assert r["p"] == unicodedata.normalize("NFKC", re.sub(r"<[^>]+>", " ", html.unescape(t))).casefold(), t
