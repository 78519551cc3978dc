"""Rules, joins, decisions and displayed values over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.labels import COUNTRIES, EXCLUSIONS
from ..functions.numbers import percent, shown_percent
from ..operators import agreement as A
from ..operators import frequency as Q
from ..operators import geography as G
from ..operators import graphs as N
from ..operators import linkage as L
from ..operators import overlay as O
from ..operators import phrases as P
from ..operators import sampling as M
from ..operators import screening as S
from ..plans import contracts as C
from ..plans import review as R
from ..sources import sinks as K
from ..sources import tables as T
from .base import Registry, table

query = Registry()

_SHARE = "CASE WHEN {c} = 0 THEN 0.0 WHEN format('{{:.1f}}', 100.0 * {c} / {n})::DOUBLE = 0 THEN 100.0 * {c}::DOUBLE / {n} ELSE format('{{:.1f}}', 100.0 * {c} / {n})::DOUBLE END"


@query(f"""
WITH c AS (SELECT l_returnflag || l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'early ' || l_linenumber, count(*) FROM lineitem WHERE l_orderkey < 3 GROUP BY 1), t AS (SELECT count(*) AS m FROM lineitem)
SELECT label, {_SHARE.format(c='n', n='m')} AS percent, CASE WHEN 100.0 * n / m < 0.1 THEN '<0.1%' ELSE 'shown' END AS printed FROM c, t""")
def table_percent(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    parts = li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("label")).agg(F.count("*").alias("n"))
    early = li.filter("l_orderkey < 3").groupBy(F.concat(F.lit("early "), "l_linenumber").alias("label")).agg(F.count("*").alias("n"))
    both = parts.unionByName(early).crossJoin(F.broadcast(li.agg(F.count("*").alias("m"))))  # one row
    printed = F.when(shown_percent(F.col("n"), F.col("m")) == "<0.1%", "<0.1%").otherwise("shown")
    return both.select("label", percent(F.col("n").cast("double"), F.col("m").cast("double")).alias("percent"), printed.alias("printed"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS squeezed FROM documents")
def squeezed_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.squeeze("text").alias("squeezed"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'id:' || s_suppkey WHEN s_suppkey % 4 = 1 THEN 'issn:' || s_nationkey WHEN s_suppkey % 4 = 2 THEN 'name:' || lower(s_name) ELSE 'unknown' END AS key,
 CASE WHEN s_suppkey % 4 = 3 THEN 'Unknown source' WHEN s_suppkey % 8 = 0 THEN s_suppkey::VARCHAR ELSE s_name END AS display FROM supplier""")
def source_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    s = table(spark, d, "supplier").select("s_suppkey", F.when(k == 0, F.col("s_suppkey").cast("string")).alias("sid"), F.when(k == 1, F.col("s_nationkey").cast("string")).alias("issn"), F.when((k != 3) & (F.col("s_suppkey") % 8 != 0), F.concat(F.lit("  "), "s_name")).alias("name"))
    return s.withColumn("x", X.source_key("sid", "issn", "name")).select("s_suppkey", "x.key", "x.display")


@query("SELECT p_partkey, '10.' || p_partkey || '/' || lower(replace(p_brand, '#', '')) AS doi FROM part")
def doi_forms(spark: SparkSession, d: str) -> DataFrame:
    heads = F.element_at(F.array(*(F.lit(x) for x in ("", "https://doi.org/", "HTTP://doi.org/", "doi:", "https://DOI.org/doi: "))), (F.col("p_partkey") % 5 + 1).cast("int"))
    raw = F.concat(heads, F.lit("10."), "p_partkey", F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(". "))
    return table(spark, d, "part").select("p_partkey", X.doi(raw).alias("doi"))


@query("""
SELECT p_partkey, array_to_string(list_filter(list_distinct_in_order, lambda w: len(w) > 1 AND w NOT IN ('a','an','and','for','in','of','on','the','to','using','with')), ';') AS tokens FROM (
 SELECT p_partkey, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_in_order FROM (SELECT p_partkey, string_split(lower(p_name || ' of the ' || p_type || ' a ' || p_name), ' ') AS w FROM part))""")
def title_words(spark: SparkSession, d: str) -> DataFrame:
    title = F.lower(F.concat("p_name", F.lit(" of the "), "p_type", F.lit(" a "), "p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.title_tokens(title), ";").alias("tokens"))


@query("SELECT n_nationkey, 'lee;o''brien-smith;' || lower(chr(97 + n_nationkey) || 'son') AS authors FROM nation")
def author_words(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("j. lee ; m o'brien-smith;9; "), F.lower(F.concat(F.char(F.lit(97) + F.col("n_nationkey")), F.lit("son"))), F.lit(" 3"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(X.author_tokens(raw), ";").alias("authors"))


@query("""
SELECT DISTINCT e.event_type AS label, CASE e.event_type WHEN 'error' THEN 'A fault' ELSE upper(event_type[1]) || lower(event_type[2:]) END AS display FROM events e UNION ALL SELECT DISTINCT o_orderpriority, replace(o_orderpriority, '_', ' ') FROM orders UNION ALL SELECT DISTINCT 'kind_' || lower(o_orderstatus), 'Kind ' || lower(o_orderstatus) FROM orders""")
def display_labels(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    raw = table(spark, d, "events").select(F.col("event_type").alias("label")).distinct().union(o.select("o_orderpriority").distinct()).union(o.select(F.concat(F.lit("kind_"), F.lower("o_orderstatus"))).distinct())
    return raw.select("label", X.display("label", {"error": "A fault"}).alias("display"))


@query("SELECT n_nationkey, CASE n_nationkey WHEN 0 THEN 'United States (US)' WHEN 1 THEN 'Germany (DE)' ELSE 'X' || n_nationkey END AS country FROM nation")
def country_labels(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("n_nationkey") == 0, " us").when(F.col("n_nationkey") == 1, "De").otherwise(F.concat(F.lit("x"), "n_nationkey"))
    return table(spark, d, "nation").select("n_nationkey", X.coded(code, COUNTRIES).alias("country"))


_CODES = sorted(EXCLUSIONS)


@query("WITH k(code, display) AS (VALUES " + ", ".join(f"('{c}', '{EXCLUSIONS[c]}')" for c in _CODES) + "), o AS (SELECT (['" + "','".join(_CODES) + f"'])[o_custkey % {len(_CODES)} + 1] AS code, count(*)::BIGINT AS count FROM orders GROUP BY 1) SELECT code AS label, count, display FROM o JOIN k USING (code)")
def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*(F.lit(c) for c in _CODES)), (F.col("o_custkey") % len(_CODES) + 1).cast("int"))
    return C.exclusion_labels(table(spark, d, "orders").groupBy(code.alias("label")).agg(F.count("*").alias("count")))


@query("""
SELECT p_partkey, array_to_string(list_transform(list_sort([{'k': lower(w), 'x': w} FOR w IN list_filter(ws, lambda x, i: list_position(list_transform(ws, lambda y: lower(y)), lower(x)) = i)]), lambda s: s.x), ';') AS words
FROM (SELECT p_partkey, list_concat(string_split(p_type, ' '), string_split(p_name, ' '), string_split(lower(p_type), ' '), [upper(p_brand)]) AS ws FROM part)""")
def unique_labels(spark: SparkSession, d: str) -> DataFrame:
    items = F.concat(F.split("p_type", " "), F.split("p_name", " "), F.split(F.lower("p_type"), " "), F.array(F.upper("p_brand"), F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.unique_texts(items), ";").alias("words"))


@query("SELECT page_id, url || ';https://doi.org/10.1/' || page_id AS urls FROM pages")
def page_addresses(spark: SparkSession, d: str) -> DataFrame:
    urls = X.url_list(F.array(F.col("url"), F.upper("url")), F.concat(F.lit("doi:10.1/"), "page_id"))
    return table(spark, d, "pages").select("page_id", F.array_join(urls, ";").alias("urls"))


@query("SELECT a.o_orderkey AS left, b.o_orderkey AS right, abs(year(a.o_orderdate) - year(b.o_orderdate))::INTEGER AS gap FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.o_custkey % 10 = 0")
def year_gaps(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_custkey % 10 = 0").select("o_orderkey", "o_custkey", X.year(F.year("o_orderdate").cast("string")).alias("y"))
    a, b = o.select(F.col("o_orderkey").alias("left"), F.col("o_custkey").alias("c"), F.col("y").alias("ya")), o.select(F.col("o_orderkey").alias("right"), F.col("o_custkey").alias("c"), F.col("y").alias("yb"))
    return a.join(b, "c").filter(F.col("left") < F.col("right")).select("left", "right", F.abs(F.col("ya") - F.col("yb")).alias("gap"))


@query("SELECT conv_id, count(*)::BIGINT AS authors, string_agg(DISTINCT upper(role[1:2]), ';' ORDER BY upper(role[1:2])) AS countries FROM conversations GROUP BY 1")
def parsed_author_lists(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct(F.concat(F.lit("A"), "turn").alias("author_id"), F.col("role").alias("author_name"), F.lit(None).cast("string").alias("orcid"), F.array().cast("array<string>").alias("institution_ids"), F.array(F.concat(F.lit(" "), F.substring("role", 1, 2))).alias("countries"))
    works = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(one)).alias("json"))
    got = works.withColumn("a", G.parsed_authors("json"))
    return got.select("conv_id", F.size("a").cast("long").alias("authors"), F.array_join(F.array_sort(G.work_countries("a")), ";").alias("countries"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS reviewed FROM events")
def review_times(spark: SparkSession, d: str) -> DataFrame:
    t = F.date_trunc("second", "ts")
    shaped = F.when(F.col("event_id") % 3 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("2024-02-30T00:00:00Z"))
    return table(spark, d, "events").select("event_id", F.date_format(X.utc_time(shaped), "yyyy-MM-dd HH:mm:ss").alias("reviewed"))


@query("SELECT o_orderkey, o_custkey, o_totalprice * 2 AS twice FROM orders")
def one_to_one_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("place", F.col("o_orderkey"))
    other = o.select("o_orderkey", "place", (F.col("o_totalprice") * 2).alias("twice"))
    return O.one_to_one(o.select("o_orderkey", "place", "o_custkey"), other, "o_orderkey", "place").select("o_orderkey", "o_custkey", "twice")


@query("SELECT o_orderkey, o_orderkey AS first, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey + 1 END AS second FROM orders WHERE o_orderkey % 3 = 0")
def order_differences(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("place"))
    other = o.filter("o_orderkey % 3 <> 0 or o_orderkey % 6 = 0").withColumn("place", F.when(F.col("o_orderkey") % 6 == 0, F.col("place") + 1).otherwise(F.col("place")))
    return O.order_faults(o, other, "o_orderkey", "place")


_RATING = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'UNCERTAIN' WHEN quality = 1 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS a, CASE WHEN doc_id % 5 = 0 THEN 'UNCERTAIN' WHEN toxic = 1 THEN 'EXCLUDE' ELSE 'INCLUDE' END AS b, 'E' || doc_id % 2 AS ca, 'E' || doc_id % 3 AS cb FROM labels"


def _reviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, d, "labels")
    pick = lambda k, c, yes, no: F.when(F.col("doc_id") % k == 0, "UNCERTAIN").when(F.col(c) == 1, yes).otherwise(no)
    one = rows.select("doc_id", pick(7, "quality", "INCLUDE", "EXCLUDE").alias("decision"), F.concat(F.lit("E"), F.col("doc_id") % 2).alias("primary_code"))
    two = rows.select("doc_id", pick(5, "toxic", "EXCLUDE", "INCLUDE").alias("decision"), F.concat(F.lit("E"), F.col("doc_id") % 3).alias("primary_code"))
    return rows.select("doc_id"), one, two


_QUEUE = "NOT (a = b AND a <> 'UNCERTAIN' AND (a = 'INCLUDE' OR ca = cb))"


@query(f"""
SELECT doc_id, a AS reviewer_a, b AS reviewer_b, a = 'UNCERTAIN' OR b = 'UNCERTAIN' AS uncertain_present, a <> b AND a <> 'UNCERTAIN' AND b <> 'UNCERTAIN' AS direct, {_QUEUE} AS needs_adjudication, array_to_string(list_filter([CASE WHEN a <> b THEN 'decision' END, CASE WHEN ca <> cb THEN 'primary_code' END], lambda x: x IS NOT NULL), ';') AS differing FROM ({_RATING})""")
def review_comparison(spark: SparkSession, d: str) -> DataFrame:
    got = A.compare_reviews(*_reviews(spark, d), "doc_id", ["decision", "primary_code"])
    return got.select("doc_id", F.col("reviewer_A_decision").alias("reviewer_a"), F.col("reviewer_B_decision").alias("reviewer_b"), "uncertain_present", F.col("direct_include_exclude_disagreement").alias("direct"), "needs_adjudication", F.array_join("differing_criteria", ";").alias("differing"))


@query(f"""
SELECT doc_id, CASE WHEN {_QUEUE} THEN 'EXCLUDE' ELSE a END AS final_decision, CASE WHEN {_QUEUE} THEN 'E9' ELSE ca END AS final_primary_code, CASE WHEN {_QUEUE} THEN 'adjudicated' ELSE 'agreed' END AS decision_basis FROM ({_RATING})""")
def final_decisions(spark: SparkSession, d: str) -> DataFrame:
    both = A.compare_reviews(*_reviews(spark, d), "doc_id", ["decision"])
    adjudicated = both.filter("needs_adjudication").select("doc_id", F.lit("EXCLUDE").alias("decision"), F.lit("E9").alias("primary_code"))
    return A.resolve(both, adjudicated, "doc_id").select("doc_id", "final_decision", "final_primary_code", "decision_basis")


@query(f"SELECT doc_id FROM ({_RATING}) WHERE NOT ({_QUEUE}) AND (doc_id % 11 = 0 OR (doc_id % 2 = 0 AND a <> 'INCLUDE') OR (doc_id % 2 = 1 AND (a <> 'EXCLUDE' OR ca <> 'E1')))")
def human_discrepancies(spark: SparkSession, d: str) -> DataFrame:
    both = A.compare_reviews(*_reviews(spark, d), "doc_id", ["decision"])
    said = F.when(F.col("doc_id") % 11 == 0, "UNCERTAIN").when(F.col("doc_id") % 2 == 0, "INCLUDE").otherwise("EXCLUDE")
    human = table(spark, d, "labels").select("doc_id", said.alias("human_decision"), F.lit("E1").alias("human_primary_code"))
    return A.discrepancies(both, human, "doc_id")


@query(f"SELECT CASE WHEN a = 'INCLUDE' THEN 'INCLUDE' ELSE 'NON_INCLUDE' END AS left, CASE WHEN b = 'INCLUDE' THEN 'INCLUDE' ELSE 'NON_INCLUDE' END AS right, count(*)::BIGINT AS n FROM ({_RATING}) WHERE a <> 'UNCERTAIN' GROUP BY 1, 2")
def human_model_agreement(spark: SparkSession, d: str) -> DataFrame:
    _, one, two = _reviews(spark, d)
    both = one.select("doc_id", F.col("decision").alias("human")).join(two.select("doc_id", F.col("decision").alias("model")), "doc_id")
    return A.human_pairs(both, "human", "model").groupBy("left", "right").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*)::BIGINT AS n, count(*)::BIGINT AS agreed, 1.0::DOUBLE AS raw_agreement, 1.0::DOUBLE AS kappa FROM documents GROUP BY 1 HAVING count(*) > 0")
def certain_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Kappa where chance agreement is certain: 1 if all agree."""
    docs, out = table(spark, d, "documents").select("lang"), None
    for (lang,) in docs.distinct().collect():  # as many as languages
        got = A.agreement(docs.filter(F.col("lang") == lang).withColumn("other", F.col("lang")), "lang", "other", certain=True)
        got = got.select(F.lit(lang).alias("lang"), "n", "agreed", "raw_agreement", "kappa")
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT family_size, count(*)::BIGINT AS families FROM (SELECT count(*)::BIGINT AS family_size FROM documents GROUP BY text) GROUP BY 1")
def family_sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.sha2("text", 256).alias("provisional_family_id"))
    first = docs.groupBy("provisional_family_id").agg(F.min("paper_id").alias("m"))
    members = docs.join(first, "provisional_family_id").select("paper_id", "provisional_family_id", (F.col("paper_id") == F.col("m")).alias("preferred"))
    return R.finalize_consolidation(members, docs.limit(0).selectExpr("paper_id as left", "paper_id as right", "true as same"))["sizes"]


@query("""
WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents), p AS (SELECT a.doc_id AS l, a.doc_id + 1 AS r, a.doc_id % 2 = 0 AS same FROM documents a WHERE a.doc_id + 1 IN (SELECT doc_id FROM documents))
SELECT l AS left, r AS right, CASE WHEN same THEN 'same work in two families' ELSE 'other work in one family' END AS fault FROM p JOIN f x ON l = x.doc_id JOIN f y ON r = y.doc_id WHERE same <> (x.f = y.f)""")
def pair_family_conflicts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("t"))
    members = docs.join(docs.groupBy("t").agg(F.min("doc_id").alias("family")), "t").select("doc_id", "family")
    pairs = docs.select(F.col("doc_id").alias("left"), (F.col("doc_id") + 1).alias("right"), (F.col("doc_id") % 2 == 0).alias("same")).join(docs.select(F.col("doc_id").alias("right")), "right", "left_semi")
    return L.pair_family_faults(pairs, members, "family", "doc_id")


_ROLE = "(['preprint','final_journal_article','correction','conference_abstract','supplement'])[{k} % 5 + 1]"
_KIND = "(['preprint_to_journal','conference_to_journal','correction_of'])[s_suppkey % 3 + 1]"


@query(f"""
WITH p AS (SELECT s_suppkey AS l, s_suppkey + 1 AS r, {_KIND} AS relationship, {_ROLE.format(k='s_suppkey')} AS x, {_ROLE.format(k='(s_suppkey + 1)')} AS y FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)),
k(relationship, lacking) AS (VALUES ('preprint_to_journal','preprint'),('preprint_to_journal','final_journal_article'),('conference_to_journal','final_journal_article'),('conference_to_journal','conference_full_paper or conference_abstract'),('correction_of','correction'))
SELECT l AS left, r AS right, relationship, lacking FROM p JOIN k USING (relationship) WHERE NOT list_contains(string_split(lacking, ' or '), x) AND NOT list_contains(string_split(lacking, ' or '), y)""")
def version_role_faults(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey")
    pick = lambda xs, k: F.element_at(F.array(*(F.lit(x) for x in xs)), (k % len(xs) + 1).cast("int"))
    members = s.withColumn("version_role", pick(["preprint", "final_journal_article", "correction", "conference_abstract", "supplement"], F.col("s_suppkey")))
    pairs = s.select(F.col("s_suppkey").alias("left"), (F.col("s_suppkey") + 1).alias("right"), F.lit(S.SAME_WORK).alias("decision"), pick(["preprint_to_journal", "conference_to_journal", "correction_of"], F.col("s_suppkey")).alias("relationship"))
    return S.role_faults(pairs.join(s.select(F.col("s_suppkey").alias("right")), "right", "left_semi"), members, "s_suppkey")


@query("SELECT c_custkey, 'many lines' AS rule FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'unknown label' FROM customer WHERE c_mktsegment = 'FURNITURE' UNION ALL SELECT c_custkey, 'repeated item' FROM customer WHERE c_custkey % 4 = 0")
def review_row_faults(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    kinds = [r[0] for r in c.select("c_mktsegment").distinct().collect() if r[0] != "FURNITURE"]  # a vocabulary
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "a\nb").otherwise("seen").alias("evidence"), F.lit(None).cast("long").alias("possible_version_of"), F.when(F.col("c_custkey") % 4 == 0, F.concat("c_mktsegment", F.lit("; "), "c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("kinds"))
    names = {"evidence over several lines": "many lines", "kinds: unknown label": "unknown label", "kinds: repeated item": "repeated item", "kinds: blank item": "blank item"}
    got = S.violations(rows, S.review_rules("c_custkey", {"kinds": kinds}), ["c_custkey"])
    return got.replace(names, subset=["rule"])


@query("""
SELECT event_id, 'minutes: not a finite number' AS rule FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, 'minutes: negative' FROM events WHERE event_id % 5 = 1 AND value > 0
UNION ALL SELECT event_id, 'user_id required' FROM events WHERE event_type = 'error' AND user_id % 2 = 0 UNION ALL SELECT event_id, 'props must be blank' FROM events WHERE event_type <> 'error' AND coalesce(trim(props), '') <> ''""")
def audit_response_faults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    rows = table(spark, d, "events").select("event_id", "event_type", "props", "value", F.when(F.col("user_id") % 2 != 0, F.col("user_id")).alias("user_id"), F.when(k == 0, "inf").when(k == 1, (-F.col("value")).cast("string")).when(k == 2, " ").otherwise("3.5").alias("minutes"))
    return S.violations(rows, S.minutes_rules("minutes") | S.conditional_fields(F.col("event_type") == "error", ["user_id"], ["props"]), ["event_id"])


@query("""
SELECT p_partkey, rule FROM (SELECT p_partkey, unnest(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'words: order' END, CASE WHEN p_partkey % 7 = 0 THEN 'short rationale' END, CASE WHEN p_partkey % 4 = 0 THEN 'address' END, CASE WHEN p_size > 25 AND p_partkey % 7 <> 1 THEN 'blank kind' END], lambda x: x IS NOT NULL)) AS rule FROM part)""")
def extraction_faults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.when(k % 3 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("words"),
        F.when(k % 7 == 0, "too short").when(k % 7 == 1, "a long rationale, KIND_BLANK as stated").otherwise("a rationale that is long enough").alias("rationale"), F.when(k % 4 == 0, "ftp:/x").otherwise("https://a.org/x").alias("url"))
    rules = S.extraction_rules({"words": ["a", "b"]}, "rationale", "url") | S.marker_rules("rationale", {"blank kind": (F.col("p_size") > 25, "KIND_BLANK")})
    return S.violations(rows, rules, ["p_partkey"])


@query("""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders)
SELECT 'candidates sum' AS rule, (f + o - n)::BIGINT AS amount FROM c WHERE f + o <> n UNION ALL SELECT 'decisions sum to the candidates', (f - n)::BIGINT FROM c WHERE f <> n UNION ALL SELECT 'deduplicated records', 7 UNION ALL SELECT 'works within the included records', 1""")
def selection_contract(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").agg(F.count("*").alias("n"), *(F.sum((F.col("o_orderstatus") == x).cast("long")).alias(x.lower()) for x in "FO"))
    rows = [("retrievals", s, F.col("n") if s == "pubmed" else F.lit(0)) for s in C.SOURCES] + [("retrievals", "total", F.col("n")), ("cutoff", "total", F.lit(0)), ("after_cutoff", "total", F.col("n"))]
    rows += [("date_status", s, F.col("n") if s == "inside_window" else F.lit(0)) for s in C.DATE_STATUSES]
    rows += [(g, p, F.lit(0)) for g in ("automatic_merges", "reviewed_merges", "resolution") for p in ("some", "total")] + [("out_of_range", "total", F.lit(0)), ("after_automatic", "total", F.col("n")), ("deduplicated", "total", F.col("n") - 7)]
    rows += [("candidates", "f", F.col("f")), ("candidates", "o", F.col("o")), ("candidates", "total", F.col("n")), ("outside", "total", F.lit(-7)), ("included", "total", F.col("f")), ("excluded", "total", F.lit(0)), ("works", "total", F.col("f") + 1)]
    long = o.select(F.explode(F.array(*(F.struct(F.lit(g).alias("group"), F.lit(p).alias("part"), n.cast("long").alias("count")) for g, p, n in rows))).alias("x")).select("x.*")
    return C.selection_faults(long).filter("rule not like 'not a count%'")


@query("""
WITH c AS (SELECT CASE WHEN l_orderkey < 2 THEN 'early' WHEN l_orderkey < 3 THEN 'next' ELSE l_returnflag END AS label, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT count(*) AS m FROM lineitem)
SELECT label, 'early or so' AS shown FROM c, t WHERE 100.0 * n / m < 0.1 AND label <> 'next'""")
def tiny_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares under 0.1 % that aren't shown as such: those of the first order, which is shown by words."""
    k = F.col("l_orderkey")
    label = F.when(k < 2, "early").when(k < 3, "next").otherwise(F.col("l_returnflag"))
    counts = Q.single_response(table(spark, d, "lineitem").withColumn("label_", label), "label_")
    right = shown_percent(F.col("count"), F.col("denominator"))
    return C.tiny_share_faults(counts.withColumn("shown", F.when(F.col("label") == "next", right).otherwise(F.lit("early or so"))))


@query("""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pool_rank FROM documents), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), a AS (SELECT doc_id, lang FROM r WHERE pool_rank <= 5)
SELECT lang AS pool, r.doc_id, pool_rank::INTEGER AS pool_rank, CASE lang WHEN 'de' THEN true ELSE n >= 50 END AS complete FROM r JOIN n USING (lang) WHERE doc_id NOT IN (SELECT doc_id FROM a) AND (lang = 'de' OR (lang IN ('fr', 'es') AND pool_rank <= 50))""")
def audit_expansions(spark: SparkSession, d: str) -> DataFrame:
    """The pools DIFFICULT_ALL (German), and MIXED_EXCLUDE and SAME_EXCLUDE (French, Spanish), opened by errors."""
    pools = {"de": "DIFFICULT_ALL", "fr": "MIXED_EXCLUDE", "es": "SAME_EXCLUDE", "en": "AGREED_INCLUDE"}
    of = F.create_map(*(F.lit(x) for kv in pools.items() for x in kv))
    ranked = table(spark, d, "documents").select("doc_id", "lang", of[F.col("lang")].alias("pool"), F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("pool_rank"))
    group = F.when(F.col("lang") == "de", "A_DIFFICULT").when(F.col("lang") == "en", "B_AGREED_INCLUDE").otherwise("C_AGREED_EXCLUDE")
    audited = ranked.filter("pool_rank <= 5").select("doc_id", group.alias("sample_group"), F.col("pool").alias("sample_component"), ((F.col("lang") != "en") & (F.col("pool_rank") == 1)).alias("confirmed_error"), F.lit(False).alias("second_review"), F.lit("").alias("second_decision"))
    back = F.create_map(*(F.lit(x) for k, v in pools.items() for x in (v, k)))
    return M.audit_expansion(ranked, audited, "doc_id").select(back[F.col("pool")].alias("pool"), "doc_id", "pool_rank", "complete")


@query("""
WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 20 < 2 THEN c_custkey - c_custkey % 20 ELSE c_custkey END AS family, CASE WHEN c_custkey % 20 = 1 THEN 'no' ELSE 'yes' END AS preferred, CASE WHEN c_custkey % 30 = 0 THEN 'changed' ELSE c_name END AS c_name FROM customer)
SELECT c_custkey, 'c_name' AS field, CASE WHEN c_custkey % 20 = 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer) THEN 'field that must stay' ELSE 'record of no merged family' END AS fault FROM a WHERE c_custkey % 30 = 0""")
def family_merges(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_custkey").alias("family"), F.lit("yes").alias("preferred"))
    k = F.col("c_custkey") % 20
    after = c.withColumns({"family": F.when(k < 2, F.col("c_custkey") - k).otherwise(F.col("family")), "preferred": F.when(k == 1, "no").otherwise("yes"), "c_name": F.when(F.col("c_custkey") % 30 == 0, "changed").otherwise(F.col("c_name"))})
    return O.merge_faults(c, after, "c_custkey", "family", ["c_name", "family", "preferred"], ["family", "preferred"]).select("c_custkey", "field", "fault")


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(CASE WHEN p_size % 2 = 0 THEN [p_brand, 'added'] ELSE ['unspecified', 'added'] END, lambda x: x <> 'Brand#11'))), ';') AS labels FROM part""")
def edited_labels(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("p_size") % 2 == 0
    rows = table(spark, d, "part").select("p_partkey", F.array(F.lit("unspecified")).alias("labels"), F.when(odd, F.array("p_brand")).alias("proposed"), F.array(F.lit("Brand#11")).alias("removed"), F.array(F.lit("added")).alias("added"))
    got = O.label_edits(rows, "labels", "proposed", "removed", "added", "unspecified", [])
    return got.select("p_partkey", F.array_join("labels", ";").alias("labels"))


@query("""
SELECT c_custkey, c_nationkey::BIGINT AS family_size, CASE WHEN c_custkey % 4 = 0 THEN 'pubmed;doaj;scopus' ELSE 'pubmed;doaj' END AS found_in_sources FROM customer""")
def works_with_sources(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    works = c.select("c_custkey", F.lit(0).alias("family_size"), F.array(F.lit("doaj"), F.lit("pubmed")).alias("found_in_sources"))
    sizes = c.select("c_custkey", F.col("c_nationkey").cast("long").alias("family_size"))
    got = L.with_sources(works, sizes, "c_custkey", c.filter("c_custkey % 4 = 0"), "scopus", ["openalex", "pubmed", "doaj", "scopus"])
    return got.select("c_custkey", "family_size", F.array_join("found_in_sources", ";").alias("found_in_sources"))


@query("SELECT source_corpus, count(*)::BIGINT AS rows, count(DISTINCT f)::BIGINT AS families FROM (SELECT 'base' AS source_corpus, c_nationkey AS f FROM customer UNION ALL SELECT 'increment', s_nationkey FROM supplier) GROUP BY 1")
def integrated_counts(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda t, k, f: table(spark, d, t).select(F.col(k).alias("paper_id"), F.col(f).alias("version_family_id"))
    return R.integrate(pick("customer", "c_custkey", "c_nationkey"), pick("supplier", "s_suppkey", "s_nationkey"))["counts"]


@query("""
SELECT year, coalesce(n, 0)::BIGINT AS n, coalesce(works, 0)::BIGINT AS works, coalesce(z, 0)::BIGINT AS zero_count, median, coalesce(n, 0)::BIGINT AS covered FROM (SELECT unnest(range(1990, 2001))::INTEGER AS year) LEFT JOIN (
 SELECT year(o_orderdate)::INTEGER AS year, count(*) FILTER (o_orderkey % 3 <> 0) AS n, count(*) AS works, count(*) FILTER (o_orderkey % 3 <> 0 AND o_custkey = 0) AS z, quantile_cont(o_custkey, 0.5) FILTER (o_orderkey % 3 <> 0) AS median FROM orders GROUP BY 1) USING (year)""")
def dense_distribution_by_year(spark: SparkSession, d: str) -> DataFrame:
    got = Q.distribution_of_years(table(spark, d, "orders"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")), F.year("o_orderdate"), 1990, 2000)
    return got.select("year", "n", "works", "zero_count", "median", "covered")


@query("""
WITH w AS (SELECT o_orderkey AS k, list_distinct(list(s_nationkey)) AS c FROM orders LEFT JOIN (SELECT l_orderkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey % 3 <> 0) ON o_orderkey = l_orderkey GROUP BY 1),
v AS (SELECT k, list_filter(c, lambda x: x IS NOT NULL) AS c FROM w), t AS (SELECT count(*) AS works, count(*) FILTER (len(c) > 0) AS covered FROM v)
SELECT country, whole::BIGINT AS whole, works::BIGINT AS works, covered::BIGINT AS covered, 100.0 * whole / works AS percent_of_works, CASE WHEN country IS NOT NULL THEN 100.0 * whole / covered END AS percent_of_covered FROM (
 SELECT x::VARCHAR AS country, count(*) AS whole FROM (SELECT unnest(c) AS x FROM v) GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM v WHERE len(c) = 0), t""")
def countries_of_all(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter("l_orderkey % 3 <> 0").select("l_orderkey", "l_suppkey").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    sets = li.groupBy("l_orderkey").agg(F.collect_set(F.col("s_nationkey").cast("string")).alias("c"))
    works = table(spark, d, "orders").select("o_orderkey").distinct().join(sets, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return G.country_shares(works, "c").select("country", "whole", "works", "covered", "percent_of_works", "percent_of_covered")


@query("""
WITH w AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN string_split(p_type, ' ') ELSE [] END AS ws FROM part), e AS (SELECT p_partkey, unnest(ws) AS x FROM w)
SELECT lower(x) AS folded, count(DISTINCT p_partkey)::BIGINT AS count, (SELECT count(*) FROM part)::BIGINT AS denominator FROM e GROUP BY 1 UNION ALL SELECT NULL, count(*) FILTER (len(ws) = 0), count(*) FROM w""")
def folded_with_missing(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.split("p_type", " ")).otherwise(F.array().cast("array<string>")).alias("ws"))
    return Q.folded_with_missing(w, "p_partkey", "ws", "p_partkey").select("folded", "count", "denominator")


@query("SELECT label, works FROM (SELECT w AS label, count(DISTINCT p_partkey)::BIGINT AS works, (count(DISTINCT p_partkey) >= (SELECT count(*) / 8 FROM part)) AS ok FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1) WHERE ok")
def tie_aware_top(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    counts = part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("label")).distinct().groupBy("label").agg(F.count("*").alias("works"))
    return P.frequent(counts, "works", least=-(-part.count() // 8))


@query("SELECT n_nationkey AS paper_id, n_name AS title FROM nation")
def blinded_view(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("paper_id"), F.col("n_name").alias("title"), F.lit("").alias("abstract"), F.array(F.col("n_name")).alias("keywords"))
    return R.build_screening_candidates(n, {"a": "nation_", "b": r"\d"} )["blinded"].select("paper_id", "title")


@query("SELECT c_custkey, c_name AS \"A_c_name\", c_mktsegment AS \"A_c_mktsegment\" FROM customer")
def prefixed_columns(spark: SparkSession, d: str) -> DataFrame:
    return O.prefixed(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "A_", "c_custkey")


@query("SELECT o_orderkey, 'missing' AS fault FROM orders WHERE o_orderkey % 50 = 7 UNION ALL SELECT o_orderkey, 'repeated' FROM orders WHERE o_orderkey % 50 = 9 UNION ALL SELECT -o_orderkey - 1, 'not in master' FROM orders WHERE o_orderkey % 50 = 11")
def batch_coverage(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("ordinal"))
    k = F.col("o_orderkey") % 50
    given = o.filter(k != 7).withColumn("batch", F.floor(F.col("ordinal") / 50))
    given = given.unionByName(given.filter(k == 9)).unionByName(given.filter(k == 11).withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    return T.batch_faults(given, o, "o_orderkey", "batch", "ordinal")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '<present:redacted>' ELSE '' END AS api_key, event_type AS kind FROM events")
def redacted_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.create_map(F.lit("API_Key"), F.when(F.col("event_id") % 2 == 0, "secret").otherwise(""), F.lit("kind"), F.col("event_type")).alias("params"))
    got = T.redacted(rows, "params", ["api_key"])
    return got.select("event_id", F.col("params")["API_Key"].alias("api_key"), F.col("params")["kind"].alias("kind"))


@query("SELECT 'a/' || n_nationkey AS path, CASE n_nationkey % 5 WHEN 0 THEN 'size' WHEN 1 THEN 'digest' WHEN 2 THEN 'missing' ELSE 'not in ledger' END AS fault FROM nation WHERE n_nationkey % 5 < 4")
def ledger_differences(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 5
    n = table(spark, d, "nation").select(F.concat(F.lit("a/"), "n_nationkey").alias("path"), F.col("n_nationkey").cast("long").alias("bytes"), F.sha2("n_name", 256).alias("sha256"), k.alias("k"))
    seen = n.filter("k <> 2").select("path", F.when(F.col("k") == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(F.col("k") == 1, F.sha2("path", 256)).otherwise(F.upper("sha256")).alias("sha256"))
    return K.ledger_faults(n.filter("k <> 3").drop("k"), seen)


@query("""
WITH b(k, lo, hi) AS (VALUES (0, 0.0, 0.308497), (1, 0.002529, 0.445016), (3, 0.066740, 0.652453), (5, 0.187086, 0.812914), (10, 0.691503, 1.0))
SELECT n_nationkey, k::BIGINT AS k, lo::DOUBLE AS lower, hi::DOUBLE AS upper FROM nation JOIN b ON ([0, 1, 3, 5, 10])[n_nationkey % 5 + 1] = k""")
def exact_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Published bounds of exact 95 % intervals of k of 10."""
    k = F.element_at(F.array(*(F.lit(x) for x in (0, 1, 3, 5, 10))), (F.col("n_nationkey") % 5 + 1).cast("int")).cast("long")
    got = A.proportions(table(spark, d, "nation").select("n_nationkey", k.alias("k"), F.lit(10).cast("long").alias("n")), "k", "n")
    return got.select("n_nationkey", "k", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query("SELECT 'AFRICA' AS first_node, 0::BIGINT AS crossings, count(*)::BIGINT AS nodes FROM region")
def circular_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions as a ring: an order without crossings that begins with the first name."""
    names = [r[0] for r in table(spark, d, "region").select("r_name").orderBy("r_name").collect()]  # five rows
    mixed = names[::2] + names[1::2]
    order, cost = N.circular_order([(a, b, 1) for a, b in zip(mixed, [*mixed[1:], mixed[0]])])
    return spark.createDataFrame([(sorted(order)[0], cost, len(order))], "first_node string, crossings long, nodes long")


QUERIES, ORACLE = query.queries, query.oracle
