"""Operators on small tables."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import agreement as A
from corpusloom.operators import frequency as Q
from corpusloom.operators import geography as G
from corpusloom.operators import graphs as N
from corpusloom.operators import linkage as L
from corpusloom.operators import overlay as O
from corpusloom.operators import phrases as P
from corpusloom.operators import sampling as M
from corpusloom.operators import screening as S


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_multi_response(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, []), (4, None)], "k long, l array<string>")
    got = rows(Q.multi_response(df, "k", "l", ["a", "b", "c"], blank="none", ids=True), "label")
    assert [(x[0], x[1], x[2], x[4]) for x in got] == [("a", 2, 4, [1, 2]), ("b", 1, 4, [1]), ("c", 0, 4, None), ("none", 2, 4, [3, 4])]
    with pytest.raises(Exception, match="isn't allowed"):
        Q.multi_response(df, "k", "l", ["a"]).collect()
    assert rows(Q.multi_response(df.limit(0), "k", "l", ["a"])) == [("a", 0, 0, None)]


def test_years_outside_the_range_fail(spark):
    df = spark.createDataFrame([(2020,), (None,), (2022,)], "y int")
    got = {r["label"]: r["count"] for r in Q.yearly(df, F.col("y"), 2020, 2022, 2022).collect()}
    assert got == {"2020": 1, "2021": 0, "2022": 1, "Missing": 1}
    with pytest.raises(Exception, match="out of range"):
        Q.yearly(df, F.col("y"), 2021, 2022).collect()


def test_top_and_rest_with_ties_and_few(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", 1)], "l string, n long")
    assert rows(Q.top_and_rest(df, "l", "n", 2), "position") == [("c", 5, 1), ("a", 2, 2), ("Other", 3, 3)]
    assert rows(Q.top_and_rest(df.limit(0), "l", "n", 2)) == [("Other", 0, 1)]


def test_distribution_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([(0,), (None,), (4,)], "v long")
    assert rows(Q.distribution(df, F.col("v")))[0] == (2, 4, 2.0, 2.0, 1.0, 3.0, 0, 4, 1)
    assert rows(Q.distribution(df.limit(0), F.col("v")))[0][:4] == (0, None, None, None)


def author(i=None, n=None, o=None, inst=(), c=()):
    return (i, n, o, list(inst), list(c))


def test_identities_and_countries(spark):
    works = [
        (1, [author("https://openalex.org/A1", "Ann", None, ["i"], ["US", "gb"]), author(None, "ann", None, ["i"]), author(None, "Bob", None, [], ["CA"]), author(None, None, None, [], ["FR"])]),
        (2, [author("A1", "Ann"), author("A2", "Ann"), author(None, "Ann")]),
        (3, []),
    ]
    df = spark.createDataFrame(works, f"k long, a {G.AUTHORS}")
    got = G.identities(df, "k", "a").collect()
    assert sorted((r["work"], r["identity"].split(":")[0], r["identity"].split(":")[1]) for r in got) == [(1, "name-only", "1"), (1, "openalex", "a1"), (1, "openalex", "a1"), (2, "name-only", "2"), (2, "openalex", "a1"), (2, "openalex", "a2")]
    c = df.select("k", G.work_countries("a").alias("c"))
    assert sorted(rows(c)[0][1]) == ["CA", "GB", "US"]
    assert {r["country"]: (r["whole"], r["fractional"], r["covered"]) for r in G.country_counts(c, "c").collect()} == {x: (1, 0.333333, 1) for x in ("US", "GB", "CA")}
    assert rows(G.collaboration(c, "c")) == [(1, 1, 3)]
    assert {r["identity"]: r["works"] for r in G.productivity(G.identities(df, "k", "a")).collect()}["openalex:a1"] == 2


def test_version_pairs(spark):
    recs = [
        (1, "Chat models in surgery training", "Smith, J.; Doe, Ann", "2023"),
        (2, "Chat Models in Surgery Training!", "doe, ann", "2024"),
        (3, "Chat models in surgical training", "Smith, J.", "2022"),
        (4, "Chat models in surgery training", "Smith, J.", "2010"),
        (5, "Chat models in surgery training", "Smith, J.", ""),
        (6, "Other things", "Smith, J.", "2023"),
        (7, None, None, None),
    ]
    df = spark.createDataFrame(recs, "paper_id long, title string, authors string, year string")
    flags = spark.createDataFrame([(7, 6), (6, 7), (1, 99)], "a long, b long")
    got = {(r["left"], r["right"]): r["reasons"] for r in L.version_pairs(df, flags).collect()}
    # authors are known by their last name-like word
    from corpusloom.functions.text import fold_plain
    import difflib, re

    def tokens(a):
        found = [re.findall(r"[a-z][a-z'-]+", fold_plain(x)) for x in (a or "").split(";")]
        return {f[-1] for f in found if f}

    want = {}
    for (i, t, a, y), (j, u, b, z) in itertools.combinations(recs, 2):
        t, u = fold_plain(t or ""), fold_plain(u or "")
        gap = abs(int(y) - int(z)) if y and z else None
        words = lambda s: {w for w in s.split() if len(w) > 1 and w not in ("a", "an", "and", "for", "in", "of", "on", "the", "to", "using", "with")}
        sim = max(difflib.SequenceMatcher(None, t, u, autojunk=False).ratio(), len(words(t) & words(u)) / max(1, len(words(t) | words(u)))) if t and u else 0
        why = ["reviewer_flag"] if (i, j) == (6, 7) else []
        if t and t == u and tokens(a) & tokens(b) and (gap is None or gap <= 5):
            why.append("same_title_and_author")
        elif sim >= 0.84 and tokens(a) & tokens(b) and gap is not None and gap <= 5:
            why.append("similar_title_author_and_year")
        if why:
            want[i, j] = why
    assert got == want and len(want) >= 3


def test_families(spark):
    m = spark.createDataFrame([("f", "b", True), ("f", "a", False), ("g", "c", True)], "fam string, id string, p boolean")
    got = {r["id"]: (r["family_size"], r["preferred_key"], r["family_id"]) for r in L.families(m, "fam", "id", "p").collect()}
    import hashlib

    assert got["a"] == got["b"] == (2, "b", "VWF-" + hashlib.sha256(b"a\0b").hexdigest()[:24]) and got["c"][0] == 1
    with pytest.raises(Exception, match="not one preferred"):
        L.families(m.withColumn("p", F.lit(True)), "fam", "id", "p").collect()
    pairs = spark.createDataFrame([("a", "b", True), ("a", "c", True), ("b", "a", False), ("a", "z", True)], "left string, right string, same boolean")
    assert {r["fault"] for r in L.pair_family_faults(pairs, m, "fam", "id").collect()} == {"same work in two families", "other work in one family", "end without family"}
    moved = m.withColumn("fam", F.when(F.col("id") == "a", "g").otherwise(F.col("fam")))
    assert L.same_partition(m, m.withColumn("fam", F.upper("fam")), "fam", "id").count() == 0 and L.same_partition(m, moved, "fam", "id").count() == 4


def test_samples_don_t_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).cast("string").alias("pool"))
    one = rows(M.sample(df, "s", "pool", "id", 5).select("id", "pool_rank"), "id")
    assert one == rows(M.sample(df.repartition(7), "s", "pool", "id", 5).select("id", "pool_rank"), "id") and len(one) == 15
    got = M.batches(df.repartition(5), ["id"], 50)
    assert rows(got.select("row_number", "batch"), "id") == [(i + 1, i // 50 + 1) for i in range(500)]


def test_batches_of_many_rows_with_a_payload(spark):
    df = spark.range(400_000).select(F.xxhash64("id").alias("id"), F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = M.batches(df.repartition(13), ["id"], 50)
        n, low, high, order = got.agg(F.count_distinct("row_number"), F.min("row_number"), F.max("row_number"), F.corr(F.col("row_number").cast("double"), F.col("id").cast("double"))).first()
        assert (n, low, high) == (400_000, 1, 400_000) and order > 0.99
        falls = got.select("id", F.lag("id").over(Window.partitionBy("batch").orderBy("row_number")).alias("before")).filter("before > id")
        assert falls.count() == 0 and got.groupBy("batch").count().filter("count <> 50").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_quotas():
    assert M.two_pool_quotas((100, 100), 40, (10, 10)) == (20, 20)
    assert M.two_pool_quotas((5, 100), 40, (10, 10)) == (5, 35)
    with pytest.raises(ValueError):
        M.two_pool_quotas((5, 5), 40, (10, 10))
    assert M.boundary_quotas({"a": 3, "b": 30, "c": 30}, {"a": 10, "b": 5, "c": 5}, 20) == {"a": 3, "b": 12, "c": 5}


def test_difficult_sample(spark):
    df = spark.createDataFrame([(i, i % 10 == 0, i % 3 == 0, i % 2 == 0) for i in range(60)], "id long, missing boolean, uncertain boolean, disagree boolean")
    got = M.difficult(df, "s", "id", 20).collect()
    assert len(got) == 20 == len({r["id"] for r in got}) and all(r["id"] % 3 == 0 or r["id"] % 2 == 0 for r in got)
    assert M.difficult(df.limit(4), "s", "id", 20).count() == df.limit(4).filter("uncertain or disagree").count()


def test_sharing_out_difficult_records():
    pools = ("MISSING", "UNCERTAIN", "DISAGREE", "DIFFICULT_FILL")
    counted = lambda queues, n: [sum(p == q for p in M.share_out(dict(zip(pools, queues)), n).values()) for q in pools]
    m, u, d = list(range(10)), list(range(100, 150)), list(range(200, 250))
    assert counted((m, u, d, m + u + d), 40) == [10, 15, 15, 0]
    assert counted((m[:3], u, d, m + u + d), 40) == [3, 19, 18, 0]  # seven more, the odd one uncertain
    assert counted((m, u[:4], d, m + u + d), 40) == [10, 4, 26, 0] and counted((m, u, d[:4], m + u + d), 40) == [10, 26, 4, 0]
    assert counted((m + u, u[:2], d[:2], m + u + d), 40) == [10, 2, 2, 26]
    assert counted((m, u, u, m + u), 40) == [10, 15, 15, 0] and counted((m, u[:20], u[:20], m + u), 40) == [10, 15, 5, 10]
    assert counted(([], [], [], []), 40) == [0, 0, 0, 0]
    assert len(M.share_out(dict(zip(pools, (u, u, u, u))), 40)) == 40


def test_corrections(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id long, x string, n long")
    fix = lambda *r: spark.createDataFrame(list(r), "id long, field string, expected_old string, new_value string")
    assert rows(O.corrected(df, fix((1, "x", "a", "A"), (1, "n", "5", "6"), (2, "n", None, "7")), "id", ["x", "n"]), "id") == [(1, "A", 6), (2, "b", 7)]
    for bad, why in (((1, "x", "z", "A"), "stale"), ((3, "x", "a", "A"), "no such row"), ((1, "y", "a", "A"), "no such field")):
        with pytest.raises(Exception, match=why):
            O.corrected(df, fix(bad), "id", ["x", "n"]).collect()
    d = O.differences(df, df.withColumn("x", F.lit("b")), "id", ["x", "n"])
    assert rows(d) == [(1, "x", "a", "b")]
    assert O.unexpected(d, d).count() == 0 and O.unexpected(d, d.limit(0)).count() == 1
    with pytest.raises(ValueError):
        O.one_to_one(df, df.union(df), "id")


def test_label_edits(spark):
    df = spark.createDataFrame([(["u"], ["B", "A"], [], ["C"]), (["A", "u"], [], ["A"], []), (["A"], ["B"], None, None)], "l array<string>, p array<string>, r array<string>, a array<string>")
    assert [r[0] for r in O.label_edits(df, "l", "p", "r", "a", "u", ["C", "A"]).collect()] == [["C", "A", "B"], ["u"], ["A"]]


def decision(**kw):
    base = dict(paper_id="p", decision="INCLUDE", primary_code="INCLUDE") | {c: "yes" for c in S.CRITERIA}
    return base | kw


def test_decision_rules(spark):
    cases = {
        "": decision(), "decision and code": decision(primary_code="E1_NOT_LLM"), "included without all criteria": decision(llm_explicit="no"),
        "excluded without a failed criterion": decision(decision="EXCLUDE", primary_code="E9_OTHER"), "code and criterion": decision(decision="EXCLUDE", primary_code="E1_NOT_LLM", date_eligible="no"),
        "uncertain without an unclear criterion": decision(decision="UNCERTAIN", primary_code="U4_NEED_VERSION_CHECK"), "criterion value": decision(llm_explicit="maybe"),
    }
    for want, row in cases.items():
        got = {r["rule"] for r in S.violations(spark.createDataFrame([row]), S.decision_rules(), ["paper_id"]).collect()}
        assert (want in got) if want else not got


def test_reviews(spark):
    one = spark.createDataFrame([decision(paper_id=str(i), decision=d, primary_code=c) for i, (d, c) in enumerate([("INCLUDE", "INCLUDE"), ("EXCLUDE", "E1_NOT_LLM"), ("UNCERTAIN", "U1"), ("INCLUDE", "INCLUDE")])])
    two = spark.createDataFrame([decision(paper_id=str(i), decision=d, primary_code=c, llm_explicit="no") for i, (d, c) in enumerate([("INCLUDE", "INCLUDE"), ("EXCLUDE", "E9_OTHER"), ("UNCERTAIN", "U1"), ("EXCLUDE", "E1_NOT_LLM")])])
    both = A.compare_reviews(one.select("paper_id"), one, two, "paper_id", S.CRITERIA)
    got = rows(both.select("comparison_class", "needs_adjudication", "differing_criteria"), "paper_id")
    assert [g[0] for g in got] == ["AGREED_INCLUDE", "AGREED_EXCLUDE_DIFFERENT_CODE", "BOTH_UNCERTAIN_SAME_CODE", "DIRECT_INCLUDE_EXCLUDE_DISAGREEMENT"] and got[0][2] == ["llm_explicit"]
    adj = spark.createDataFrame([("1", "EXCLUDE", "E1_NOT_LLM"), ("2", "INCLUDE", "INCLUDE"), ("3", "EXCLUDE", "E9_OTHER")], "paper_id string, decision string, primary_code string")
    assert rows(A.resolve(both, adj, "paper_id").select("final_decision", "decision_basis"), "paper_id") == [("INCLUDE", "agreed"), ("EXCLUDE", "adjudicated"), ("INCLUDE", "adjudicated"), ("EXCLUDE", "adjudicated")]
    with pytest.raises(Exception, match="not adjudicated"):
        A.resolve(both, adj.limit(1), "paper_id").collect()


def test_extraction_rules(spark):
    df = spark.createDataFrame([("p", ["b", "a"], "tbd", "ftp://x"), ("q", ["a", "a"], "a rationale that is long enough", "https://a.org/x"), ("r", ["z"], "another rationale that is fine", None)], "id string, l array<string>, why string, url string")
    got = {(r["id"], r["rule"]) for r in S.violations(df, S.extraction_rules({"l": ["a", "b"]}, "why", "url"), ["id"]).collect()}
    assert got == {("p", "l: order"), ("p", "placeholder"), ("p", "short rationale"), ("p", "address"), ("q", "l: repeated label"), ("r", "l: unknown label")}


def test_pairs_of_phrases(spark):
    found = P.hits(spark.createDataFrame([(1, "a b", "c"), (2, "a", "b"), (3, "", None)], "k long, t string, u string"), "k", ["t", "u"], {"A": ["a"], "B": ["b"], "C": ["c"], "Z": ["z"]})
    assert sorted(rows(found)) == [(1, "A", True, True, False), (1, "B", True, True, False), (1, "C", True, False, True), (2, "A", True, True, False), (2, "B", True, False, True)]
    t = {(r["left"], r["right"]): (r["count"], r["cosine"]) for r in P.pair_table(found, "k", ["A", "B", "C", "Z"]).collect()}
    assert len(t) == 6 and t["A", "B"] == (2, 1.0) and t["A", "C"] == (1, pytest.approx(0.5**0.5)) and t["A", "Z"] == (0, None)
    assert rows(P.frequency(found, ["t", "u"], ["A", "Z"]), "label") == [("A", 2, 2, 0), ("Z", 0, 0, 0)]


def test_graphs(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)]
    got = {r["node"]: r["component"] for r in N.connected(spark.createDataFrame(edges, "left long, right long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    comp = N.connected(spark.createDataFrame(edges, "left long, right long"))
    assert [r["node"] for r in N.largest_component(comp, 3).collect()] == [0, 1, 2]
    # a square with its sides in a bad order can be drawn without crossings
    order, cost = N.circular_order([("a", "c", 1), ("c", "b", 1), ("b", "d", 1), ("d", "a", 1)], starts=4)
    assert cost == 0 and N.crossings(["a", "b", "c", "d"], [("a", "c"), ("b", "d")]) == 1 and sorted(order) == ["a", "b", "c", "d"]
    places = N.spring_layout(["a", "b", "c"], [("a", "b", 1.0)], seed=1)
    assert places == N.spring_layout(["a", "b", "c"], [("a", "b", 1.0)], seed=1)


def test_near_sets_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 3)) for _ in range(12)] for _ in range(8)]
    sets = {i: sorted(set(base[i % 8][: rng.randint(9, 12)])) for i in range(40)}
    df = spark.createDataFrame(list(sets.items()), "id long, t array<string>")
    got = {(r["left"], r["right"]) for r in L.shared_token_pairs(df, "id", F.col("t"), 0.8).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(sets, 2) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.8}


def test_near_sets_have_few_candidates(spark):
    import random

    rng = random.Random(5)
    sets = {i: rng.sample(range(1200), 60) for i in range(400)}
    sets |= {400 + i: [*sets[i][:57], 2000 + i] for i in range(20)} | {500: sets[0]}
    df = spark.createDataFrame([(i, [str(x) for x in t]) for i, t in sets.items()], "id long, t array<string>")
    with_hash = df.select("id", F.array_sort(F.transform("t", lambda w: F.xxhash64(w))).alias("t")).withColumn("h1", F.xxhash64("t"))
    assert 20 <= L._candidates(with_hash, 0.8).count() <= 3000  # of 88,410 pairs
    got = {(r["left"], r["right"]) for r in L.similar_classes(df, "id", F.col("t"), 0.8).collect()}
    assert got == {(i, 400 + i) for i in range(20)} | {(0, 500)}


def test_near_documents_of_any_length(spark, tmp_path):
    import re

    from corpusloom.queries import queries

    long = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    texts = ["one two three four five", "five four three two one!", " ".join(long), " ".join(long[:450]), " ".join(long[:200]), "some other words", "", None]
    texts += [" ".join(long[k : k + 60]) for k in (0, 3, 40, 43)]
    spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: set(re.split("[^a-z]+", t.lower())) - {""} for i, t in enumerate(texts) if t}
    want = {(i, j) for i, j in itertools.combinations(sets, 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert {(0, 1), (2, 3), (8, 9)} <= want
    assert {(r["left"], r["right"]) for r in queries()["near_dup_pairs_all"](spark, str(tmp_path)).collect()} == want
    assert {r["node"]: r["component"] for r in queries()["components_all"](spark, str(tmp_path)).collect()} == {x: min(p) for p in want for x in p}


def test_sets_are_packed_whole():
    rng = np.random.default_rng(4)
    words = np.unique(rng.integers(-(1 << 63), 1 << 63, 60_000))
    common = rng.permutation(words)[:40_000]
    sets = [np.sort(rng.choice(words, k, replace=False)) for k in (1, 0, 700, 3, 0, 5000, 0)] + [np.sort(common[[0, 127, 128, 255, 16383, 16384, 39_999]]), np.sort(np.setdiff1d(words, common)[:9])]
    lists = pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))
    for known in (common, common[:0]):
        code, rest = L._pack(lists, known, np.argsort(known))
        for at, size in ((0, len(sets)), (2, 4), (len(sets), 0)):
            tokens, n = L._unpack(code.slice(at, size), rest.slice(at, size), known)
            assert n.tolist() == [len(x) for x in sets[at : at + size]]
            assert [sorted(x) for x in np.split(tokens, np.cumsum(n)[:-1])][:size] == [x.tolist() for x in sets[at : at + size]]
    code, rest = L._pack(lists, common, np.argsort(common))
    assert code.nbytes + rest.nbytes < 0.6 * lists.nbytes


def test_few_bytes_move_for_alike_sets(spark):
    import random

    rng = random.Random(7)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    base = [rng.sample(words, 300) for _ in range(4)]
    sets = {i: [w for w in base[i % 4] if rng.random() < 0.97] for i in range(80)} | {80: [], 81: base[0][:1], 82: base[0][:1]}
    df = spark.createDataFrame(list(sets.items()), "id long, t array<string>")
    alike = {p for p in itertools.combinations(sets, 2) if len({*sets[p[0]]} & {*sets[p[1]]}) >= 0.8 * max(1, len({*sets[p[0]]} | {*sets[p[1]]}))}
    assert {(r["left"], r["right"]) for r in L.shared_token_pairs(df, "id", F.col("t"), 0.8).collect()} == alike
    _, members = L._classes(df, "id", F.col("t"), 0.8)
    got = members.collect()
    # classes have small numbers of their own, and a set is moved by bytes, not by 64-bit hashes
    assert sorted({r["c"] for r in got}) == list(range(len({r["head"] for r in got}))) and {r["id"]: r["head"] for r in got}[82] == 81


def test_alike_titles_in_blocks(spark, monkeypatch):
    import random

    from corpusloom.functions.text import TITLE_STOPWORDS, gestalt

    monkeypatch.setattr(L, "TITLES", 10)
    rng = random.Random(2)
    words = "chat model surgery training language student nurse the of on skill 42".split()
    base = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(6)]
    titles = {b if k == 0 else b.replace(rng.choice("aeiou"), rng.choice("xyz"), 1) for b in base for k in range(5)} | {"a", "nurse of chat surgery", "surgery chat nurse on the of"}
    sets = {t: {w for w in t.split() if len(w) > 1 and w not in TITLE_STOPWORDS} for t in titles}
    alike = lambda t, u: max(gestalt(t, u), gestalt(u, t), len(sets[t] & sets[u]) / max(1, len(sets[t] | sets[u]))) >= 0.84
    want = {(t, u) for t, u in itertools.combinations(sorted(titles), 2) if alike(t, u)}
    got = L._alike_titles(spark.createDataFrame([("x", t) for t in titles], "author string, title string"), 0.84)
    assert {(r["t"], r["u"]) for r in got.collect()} == want and ("nurse of chat surgery", "surgery chat nurse on the of") in want


def test_gestalt_of_many_pairs():
    import random

    from corpusloom.functions.text import gestalt, gestalts

    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abé😀 ") for _ in range(rng.randrange(n)))
    pairs = [(text(30), text(30)) for _ in range(800)] + [(None, "a"), ("", ""), ("a", ""), ("ab" * 200, "ba" * 210), ("x" * 300, "x" * 299)]
    assert gestalts(*zip(*pairs)).tolist() == [gestalt(x, y) for x, y in pairs] and gestalts([], []).tolist() == []


def test_common_subsequences_of_titles():
    import random

    def length(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            row = list(itertools.accumulate(range(1, len(y) + 1), lambda best, j: max(best, row[j], row[j - 1] + (a == y[j - 1])), initial=0))
        return row[-1]

    rng = random.Random(4)
    names = ["".join(rng.choice("ab z9") for _ in range(rng.randrange(1, n))) for n in (10, 70, 150) for _ in range(20)] + ["a" * n for n in (63, 64, 65, 128)]
    x, y = (np.array(v) for v in zip(*itertools.product(range(40, 64), range(0, 64, 3))))
    assert L._Titles(names).common(x, y).tolist() == [length(names[a], names[b]) for a, b in zip(x, y)]


def test_few_titles_need_their_gestalt(monkeypatch):
    """Titles of the same syllables have characters and neighbours in common; they are alike only if these keep their order."""
    import random

    rng = random.Random(5)
    names = sorted({"".join(rng.choice(["er", "th", "on", "an", "in", " ", "the ", "en", "st"]) for _ in range(28))[:59].strip() for _ in range(400)})
    names += [n[:30] + "x" + n[30:] for n in names[:20]]
    compared, real = [], L.gestalts
    monkeypatch.setattr(L, "gestalts", lambda x, y: compared.extend(zip(x, y)) or real(x, y))
    n = len(names)
    block = {"author": ["x"] * n, "title": names, "chief": ["x"] * n, "part": pa.array([0] * n, pa.int32()), "i": pa.array([0] * n, pa.int32()), "j": pa.array([0] * n, pa.int32())}
    got = L._alike_in_block(pa.table(block), 0.84)
    assert {(min(a, b), max(a, b)) for a, b in zip(names, names[n - 20 :])} <= set(zip(got["t"].to_pylist(), got["u"].to_pylist())) and len(compared) < 200
    # whom both titles have beside x, and who has more, compares them
    assert L._alike_in_block(pa.table(block | {"chief": ["y"] * n}), 0.84).num_rows == 0


@pytest.mark.parametrize("copies, titles", [(512, 4096), (2, 5)])
def test_version_pairs_against_brute_force(spark, monkeypatch, copies, titles):
    import random

    from corpusloom.functions.text import TITLE_STOPWORDS, gestalt

    monkeypatch.setattr(L, "COPIES", copies)
    monkeypatch.setattr(L, "TITLES", titles)
    rng = random.Random(6)
    base = ["chat models in surgery training", "nurse students and language skills", "surgery of the nurse", "a", ""]
    names = base + ["chat model in surgery training", "training chat models surgery", "nurse student and language skill", "language skills nurse students", "nurse of surgery", "chat models in surgery training " + "and long words " * 8]
    rows = [(i, rng.choice(names), rng.sample(["Ann Ash", "Bo Birch", "Cy Cedar"], rng.randrange(4)), rng.choice([None, 2010, 2012, 2014, 2018])) for i in range(120)]
    flags = [(3, 1), (1, 3), (5, 5), (7, 90)] + [(rng.randrange(120), rng.randrange(120)) for _ in range(600)]
    named = {(min(p), max(p)) for p in flags if p[0] != p[1]}
    words = lambda t: {w for w in t.split(" ") if len(w) > 1 and w not in TITLE_STOPWORDS}
    want = set()
    for (l, t, some, x), (r, u, others, y) in itertools.combinations(rows, 2):
        shared = sorted({a.split()[1].lower() for a in some} & {a.split()[1].lower() for a in others})
        gap = None if x is None or y is None else abs(x - y)
        either = words(t) | words(u)
        like = 1.0 if t == u != "" else 0.0 if not t or not u else max(gestalt(t.strip(), u.strip()), len(words(t) & words(u)) / len(either) if either else 0.0)
        same = t == u != "" and shared and (gap is None or gap <= 5)
        alike = not same and like >= 0.84 and shared and gap is not None and gap <= 5
        reasons = ["reviewer_flag"] * ((l, r) in named) + ["same_title_and_author"] * bool(same) + ["similar_title_author_and_year"] * bool(alike)
        if reasons:
            want.add((l, r, round(like, 9), ";".join(shared), gap, ";".join(reasons)))
    df = spark.createDataFrame([(i, t, ";".join(a), y and str(y)) for i, t, a, y in rows], "paper_id long, title string, authors string, year string")
    got = [(r["left"], r["right"], round(r["similarity"], 9), ";".join(r["shared_authors"]), r["year_gap"], ";".join(r["reasons"])) for r in L.version_pairs(df, spark.createDataFrame(flags, "a long, b long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({r[-1] for r in want}) == 5


def test_version_candidates_of_titles_that_occur_once(spark, tmp_path):
    import difflib

    from corpusloom.queries import queries

    texts = ["Chat models in surgery training", "Chat models in surgical training", "Other things altogether", "Chat model in surgery training", "Other things altogether"]
    spark.createDataFrame([(i + 1, t, "en", f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    low = [t.lower() for t in texts]
    want = {(i + 1, j + 1) for i, j in itertools.combinations(range(len(low)), 2) if difflib.SequenceMatcher(None, low[i], low[j], autojunk=False).ratio() >= 0.84}
    assert {(1, 2), (3, 5)} <= want
    assert {(r["left"], r["right"]) for r in queries()["version_candidates"](spark, str(tmp_path)).collect()} == want
