"""Frequencies, coverage, distributions, geography and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import percent, shown_percent, wilson
from ..operators import agreement as A
from ..operators import frequency as Q
from ..operators import geography as G
from ..operators.results import long_rows
from .base import Registry, table

query = Registry()


def _part_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"))


@query("""
WITH each AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS label FROM part),
names AS (SELECT DISTINCT label FROM each UNION SELECT 'unused label'),
n AS (SELECT count(*) AS denominator FROM part)
SELECT names.label, count(each.p_partkey)::BIGINT AS count, any_value(n.denominator) AS denominator, 100.0 * count(each.p_partkey) / any_value(n.denominator) AS percent
FROM names CROSS JOIN n LEFT JOIN each ON each.label = names.label GROUP BY names.label""")
def freq_multi(spark: SparkSession, d: str) -> DataFrame:
    w = _part_words(spark, d)
    known = w.select(F.explode("words").alias("label")).distinct().union(spark.createDataFrame([("unused label",)], "label string"))
    return Q.multi_response(w, "p_partkey", "words", known)


@query("""
WITH each AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS label FROM part)
SELECT label, count(*)::BIGINT AS count, string_agg(p_partkey::VARCHAR, ';' ORDER BY p_partkey) AS work_ids FROM each GROUP BY label""")
def freq_multi_ids(spark: SparkSession, d: str) -> DataFrame:
    got = Q.multi_response(_part_words(spark, d), "p_partkey", "words", ids=True)
    return got.select("label", "count", F.array_join(F.col("work_ids").cast("array<string>"), ";").alias("work_ids"))


@query("""
WITH v(label) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NEVER')), n AS (SELECT count(*) AS denominator FROM orders),
c AS (SELECT o_orderpriority AS label, count(*) AS count FROM orders GROUP BY 1)
SELECT coalesce(v.label, c.label) AS label, coalesce(c.count, 0)::BIGINT AS count, denominator, 100.0 * coalesce(c.count, 0) / denominator AS percent FROM v FULL JOIN c ON v.label = c.label CROSS JOIN n""")
def freq_single_zero(spark: SparkSession, d: str) -> DataFrame:
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"]
    return Q.single_response(table(spark, d, "orders"), "o_orderpriority", names).withColumn("count", F.col("count").cast("long"))


@query("""
WITH s AS (SELECT y::VARCHAR AS label FROM generate_series(1990, 2003) t(y) UNION ALL SELECT 'Missing'), c AS (SELECT coalesce(year(o_orderdate)::VARCHAR, 'Missing') AS label, count(*) AS count FROM orders GROUP BY 1), n AS (SELECT count(*) AS denominator FROM orders)
SELECT s.label, coalesce(c.count, 0)::BIGINT AS count, denominator, 100.0 * coalesce(c.count, 0) / denominator AS percent, s.label = '1998' AS partial FROM s LEFT JOIN c ON s.label = c.label CROSS JOIN n""")
def annual_spine(spark: SparkSession, d: str) -> DataFrame:
    return Q.yearly(table(spark, d, "orders"), F.year("o_orderdate"), 1990, 2003, 1998)


@query("""
WITH each AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS label FROM part), kept AS (SELECT * FROM each WHERE label NOT LIKE 's%')
SELECT label, count(*)::BIGINT AS count, (SELECT count(DISTINCT p_partkey) FROM kept) AS denominator, 100.0 * count(*) / (SELECT count(DISTINCT p_partkey) FROM kept) AS percent FROM kept GROUP BY label""")
def secondary_denominator(spark: SparkSession, d: str) -> DataFrame:
    w = _part_words(spark, d).withColumn("words", F.filter("words", lambda x: ~x.startswith("s")))
    return Q.labelled_only(w, "words")


@query("""
SELECT unnest(['labelled', 'quality', 'long', 'english']) AS measure, unnest([l, q, g, e])::BIGINT AS present, n - unnest([l, q, g, e])::BIGINT AS missing, n AS denominator FROM
(SELECT count(*) AS n, count(b.doc_id) AS l, count(*) FILTER (b.quality = 1) AS q, count(*) FILTER (d.n_chars > 2000) AS g, count(*) FILTER (d.lang = 'en') AS e FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id)""")
def coverage_pairs(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("k"), "quality")
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    got = docs.join(labels, docs["doc_id"] == labels["k"], "left")
    return Q.coverage(got, {"labelled": F.col("k").isNotNull(), "quality": F.col("quality") == 1, "long": F.col("n_chars") > 2000, "english": F.col("lang") == "en"})


@query("""
WITH c AS (SELECT n_name AS label, count(*) AS count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY count DESC, label) AS k FROM c)
SELECT label, count::BIGINT AS count, k::INTEGER AS position FROM r WHERE k <= 10 UNION ALL SELECT 'Other', coalesce(sum(count) FILTER (k > 10), 0)::BIGINT, (count(*) FILTER (k <= 10) + 1)::INTEGER FROM r""")
def topk_other(spark: SparkSession, d: str) -> DataFrame:
    # lines are counted by supplier before names are joined: the join then has a row for each supplier
    by = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    counts = by.join(s, by["l_suppkey"] == s["s_suppkey"]).join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).groupBy(F.col("n_name").alias("label")).agg(F.sum("n").alias("count"))
    return Q.top_and_rest(counts, "label", "count", 10)


_DIST = "count(v)::BIGINT AS n, sum(v) AS sum, avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, min(v) AS min, max(v) AS max, count(*) FILTER (v = 0)::BIGINT AS zero_count"


@query(f"SELECT {_DIST} FROM (SELECT p_size::BIGINT AS v FROM part)")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    return Q.distribution(table(spark, d, "part"), F.col("p_size").cast("long")).withColumn("mean", F.col("mean"))


@query(f"SELECT year, {_DIST} FROM (SELECT year(o_orderdate)::INTEGER AS year, floor(o_totalprice)::BIGINT AS v FROM orders) GROUP BY year")
def distribution_by_year(spark: SparkSession, d: str) -> DataFrame:
    return Q.distribution(table(spark, d, "orders").withColumn("year", F.year("o_orderdate")), F.floor("o_totalprice"), ["year"])


_WORKS = """
WITH own AS (SELECT DISTINCT l_orderkey, n_name AS country FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
sizes AS (SELECT l_orderkey, count(*) AS n FROM own GROUP BY 1)"""


def _works(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), F.broadcast(table(spark, d, "nation"))  # nations are a fixed list
    place = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", "n_name")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return li.join(place, li["l_suppkey"] == place["s_suppkey"]).groupBy("l_orderkey").agg(F.collect_set("n_name").alias("countries"))


@query(_WORKS + " SELECT country, count(*)::BIGINT AS whole, (SELECT count(*) FROM sizes) AS covered FROM own GROUP BY country")
def geo_whole(spark: SparkSession, d: str) -> DataFrame:
    return G.country_counts(_works(spark, d), "countries").select("country", "whole", "covered")


@query(_WORKS + " SELECT country, round(sum(1.0 / n::DOUBLE), 6) AS fractional FROM own JOIN sizes USING (l_orderkey) GROUP BY country")
def geo_fractional(spark: SparkSession, d: str) -> DataFrame:
    return G.country_counts(_works(spark, d), "countries").select("country", "fractional")


@query(_WORKS + " SELECT count(*) FILTER (n > 1)::BIGINT AS international, count(*)::BIGINT AS covered, count(*)::BIGINT AS works FROM sizes")
def intl_collab(spark: SparkSession, d: str) -> DataFrame:
    return G.collaboration(_works(spark, d), "countries")


@query("""
WITH t AS (SELECT country, whole, row_number() OVER (ORDER BY whole DESC, country) AS k FROM (SELECT country, count(*) AS whole FROM (SELECT DISTINCT l_orderkey, n_name AS country FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1)),
own AS (SELECT DISTINCT l_orderkey, n_name AS country FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey), sizes AS (SELECT l_orderkey, count(*) AS n FROM own GROUP BY 1),
f AS (SELECT country, round(sum(1.0 / n::DOUBLE), 6) AS fractional FROM own JOIN sizes USING (l_orderkey) GROUP BY country)
SELECT country, whole::BIGINT AS whole, fractional FROM t JOIN f USING (country) WHERE k <= 10""")
def topk_two_measures(spark: SparkSession, d: str) -> DataFrame:
    return G.country_counts(_works(spark, d), "countries").orderBy(F.desc("whole"), "country").limit(10).select("country", "whole", "fractional")


@query("SELECT l_suppkey AS identity, count(DISTINCT l_orderkey)::BIGINT AS works FROM lineitem GROUP BY 1")
def productivity(spark: SparkSession, d: str) -> DataFrame:
    return G.productivity(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("identity")))


@query("""
WITH c AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1), b(band) AS (VALUES ('1'), ('2'), ('3'), ('>=4'))
SELECT band, count(n)::BIGINT AS identities FROM b LEFT JOIN c ON band = CASE WHEN n >= 4 THEN '>=4' ELSE n::VARCHAR END GROUP BY band""")
def productivity_bands(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("work"), F.col("l_orderkey").alias("identity"))
    return G.bands(G.productivity(li))


@query("""
WITH r AS (SELECT event_type AS work, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS place, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'u' || (user_id % 50) END AS id, 'name ' || (user_id % 97) AS name FROM events),
one AS (SELECT work, name, min(id) AS borrowed FROM r WHERE id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT id) = 1)
SELECT r.work, CASE WHEN coalesce(id, borrowed) IS NOT NULL THEN 'openalex:' || coalesce(id, borrowed) ELSE 'name-only:' || r.work || ':' || substr(sha256(r.name || chr(0) || '' || chr(0) || ''), 1, 16) END AS identity, count(*)::BIGINT AS n
FROM r LEFT JOIN one ON r.work = one.work AND r.name = one.name GROUP BY 1, 2""")
def identity_resolution(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    author = F.struct(
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"))).alias("author_id"), F.concat(F.lit("name "), (F.col("user_id") % 97).cast("string")).alias("author_name"),
        F.lit(None).cast("string").alias("orcid"), F.array().cast("array<string>").alias("institution_ids"), F.array().cast("array<string>").alias("countries"),
    )
    # one author a row: the operator explodes them itself and matches them in each work
    works = e.select("event_type", F.array(author).alias("authors"))
    return G.identities(works, "event_type", "authors").groupBy("work", "identity").agg(F.count("*").alias("n"))


_RATED = "(SELECT CASE quality WHEN 1 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS a, CASE toxic WHEN 1 THEN 'EXCLUDE' ELSE 'INCLUDE' END AS b FROM labels)"


def _rated(spark: SparkSession, d: str) -> DataFrame:
    yes = lambda c: F.when(c, "INCLUDE").otherwise("EXCLUDE")
    return table(spark, d, "labels").select("doc_id", yes(F.col("quality") == 1).alias("a"), yes(F.col("toxic") == 0).alias("b"))


@query(f"""
WITH l(label) AS (VALUES ('INCLUDE'), ('EXCLUDE'), ('UNCERTAIN')), c AS (SELECT a, b, count(*) AS n FROM {_RATED} GROUP BY 1, 2)
SELECT x.label AS left_label, y.label AS right_label, coalesce(n, 0)::BIGINT AS count FROM l x CROSS JOIN l y LEFT JOIN c ON a = x.label AND b = y.label""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return A.confusion(_rated(spark, d), "a", "b", ["INCLUDE", "EXCLUDE", "UNCERTAIN"])


@query(f"""
WITH r AS (SELECT * FROM {_RATED}), s AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b)::DOUBLE AS k, count(*) FILTER (a = 'INCLUDE')::DOUBLE AS ai, count(*) FILTER (b = 'INCLUDE')::DOUBLE AS bi FROM r),
t AS (SELECT *, k / n AS po, (ai * bi + (n - ai) * (n - bi)) / (n * n) AS pe, 1.959963984540054 AS z FROM s)
SELECT n::BIGINT AS n, k::BIGINT AS agreed, round(po, 9) AS raw_agreement, round((po - pe) / (1 - pe), 9) AS kappa, round((po + z*z/(2*n) - z * sqrt(po*(1-po)/n + z*z/(4*n*n))) / (1 + z*z/n), 9) AS lower, round((po + z*z/(2*n) + z * sqrt(po*(1-po)/n + z*z/(4*n*n))) / (1 + z*z/n), 9) AS upper FROM t""")
def kappa(spark: SparkSession, d: str) -> DataFrame:
    got = A.agreement(_rated(spark, d), "a", "b")
    return got.select("n", "agreed", *(F.round(c, 9).alias(c) for c in ("raw_agreement", "kappa", "lower", "upper")))


@query("""
WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY 1), t AS (SELECT *, k / n::DOUBLE AS p, 1.959963984540054 AS z FROM c)
SELECT lang, k::BIGINT AS count, n::BIGINT AS n, round((p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 9) AS lower, round((p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 9) AS upper FROM t""")
def wilson_by_language(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")
    c = docs.join(labels, "doc_id").groupBy("lang").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).cast("long").alias("count"), F.count("*").alias("n"))
    ci = wilson(F.col("count"), F.col("n"))
    return c.select("lang", "count", "n", F.round(ci["lower"], 9).alias("lower"), F.round(ci["upper"], 9).alias("upper"))


@query()
def clopper_pearson(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")
    c = docs.join(labels, "doc_id").groupBy("lang").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).cast("long").alias("count"), F.count("*").alias("n"))
    return A.proportions(c, "count", "n")


@query()
def kappa_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return A.kappa_interval(_rated(spark, d), "a", "b", ["INCLUDE", "EXCLUDE"])


@query()
def kappa_bootstrap_tables(spark: SparkSession, d: str) -> DataFrame:
    return A.kappa_interval(_rated(spark, d), "a", "b", ["INCLUDE", "EXCLUDE"], paired=False)


_PAIRED = "(SELECT CASE WHEN doc_id % 7 = 0 THEN 'UNCERTAIN' WHEN quality = 1 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS a, CASE WHEN doc_id % 5 = 0 THEN 'UNCERTAIN' WHEN toxic = 1 THEN 'EXCLUDE' ELSE 'INCLUDE' END AS b, doc_id % 2 AS ca, doc_id % 3 AS cb FROM labels)"


@query(f"""
SELECT CASE WHEN a = 'UNCERTAIN' AND b = 'UNCERTAIN' THEN CASE WHEN ca = cb THEN 'BOTH_UNCERTAIN_SAME_CODE' ELSE 'BOTH_UNCERTAIN_DIFFERENT_CODE' END WHEN a = 'UNCERTAIN' OR b = 'UNCERTAIN' THEN 'ONE_UNCERTAIN' WHEN a <> b THEN 'DIRECT_INCLUDE_EXCLUDE_DISAGREEMENT'
 WHEN a = 'INCLUDE' THEN 'AGREED_INCLUDE' WHEN ca = cb THEN 'AGREED_EXCLUDE_SAME_CODE' ELSE 'AGREED_EXCLUDE_DIFFERENT_CODE' END AS comparison_class, count(*)::BIGINT AS n FROM {_PAIRED} GROUP BY 1""")
def pair_class(spark: SparkSession, d: str) -> DataFrame:
    r = _rated(spark, d)
    u = lambda k, c: F.when(F.col("doc_id") % k == 0, "UNCERTAIN").otherwise(F.col(c))
    r = r.select(u(7, "a").alias("a"), u(5, "b").alias("b"), (F.col("doc_id") % 2).alias("ca"), (F.col("doc_id") % 3).alias("cb"))
    return r.groupBy(A.pair_class("a", "b", "ca", "cb").alias("comparison_class")).agg(F.count("*").alias("n"))


@query("""
SELECT lang, CASE WHEN grouping(quality) = 1 THEN 'ALL' ELSE quality::VARCHAR END AS quality, count(*)::BIGINT AS n, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (lang, quality))""")
def stratum_subtotals(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return Q.subtotals(got, "lang", "quality", {"n": F.count("*"), "toxic": F.sum("toxic").cast("long")})


@query("""
SELECT event_type AS label, count(*) FILTER (isodow(ts) < 6)::BIGINT AS weekday, count(*) FILTER (isodow(ts) >= 6)::BIGINT AS weekend, count(*)::BIGINT AS "all" FROM events GROUP BY 1""")
def conditional_pivot(spark: SparkSession, d: str) -> DataFrame:
    week = F.dayofweek("ts").isin(1, 7)
    return Q.conditional_counts(table(spark, d, "events"), "event_type", {"weekday": ~week, "weekend": week, "all": F.lit(True)}).withColumnRenamed("event_type", "label")


@query("""
WITH b AS (SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1), a AS (SELECT p_brand AS label, count(*) AS n FROM part WHERE p_size > 25 AND p_brand <> 'Brand#11' GROUP BY 1)
SELECT label, coalesce(b.n, 0)::BIGINT AS before, coalesce(a.n, 0)::BIGINT AS after, (coalesce(a.n, 0) - coalesce(b.n, 0))::BIGINT AS change FROM b FULL JOIN a USING (label)""")
def count_changes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    n = lambda df: df.groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("count"))
    return Q.count_changes(n(p), n(p.filter("p_size > 25 and p_brand <> 'Brand#11'")))


@query("""
SELECT lower(p_type) AS folded, arg_min(p_type, p_partkey) AS label, count(*)::BIGINT AS count FROM part GROUP BY 1""")
def folded_labels(spark: SparkSession, d: str) -> DataFrame:
    return Q.folded_frequency(table(spark, d, "part").withColumn("items", F.array("p_type")), "p_partkey", "items", "p_partkey")


@query("""
SELECT 1 AS stage_order, 'documents' AS stage, count(*)::BIGINT AS count FROM documents UNION ALL SELECT 2, 'long enough', count(*) FROM documents WHERE n_chars >= 200
UNION ALL SELECT 3, 'different', count(DISTINCT text) FROM documents WHERE n_chars >= 200 UNION ALL SELECT 4, 'labelled', count(DISTINCT text) FROM documents JOIN labels USING (doc_id) WHERE n_chars >= 200""")
def selection_flow(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("t"))
    long = docs.filter("n_chars >= 200")
    return Q.flow({"documents": docs, "long enough": long, "different": long.select("t").distinct(), "labelled": long.join(table(spark, d, "labels"), "doc_id", "left_semi").select("t").distinct()})


@query("""
SELECT count(*) FILTER (p_name NOT LIKE '% %' OR split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2))::BIGINT AS count, count(*)::BIGINT AS denominator FROM part WHERE p_name LIKE '%red%' OR true""")
def one_word_only(spark: SparkSession, d: str) -> DataFrame:
    w = _part_words(spark, d).withColumn("n", F.transform("words", lambda x: F.lit("word"))).withColumn("kinds", F.when(F.size(F.array_distinct("words")) == 1, F.array(F.lit("word"))).otherwise(F.array(F.lit("word"), F.lit("other"))))
    return Q.only_label(w, "kinds", "word")


@query("""
WITH c AS (SELECT p_brand AS label, count(*)::BIGINT AS count FROM part GROUP BY 1), g AS (SELECT *, CASE WHEN label IN ('Brand#11', 'Brand#12') OR contains(label, '#5') THEN 'first' WHEN label IN ('Brand#31') THEN 'second' ELSE 'other' END AS "group" FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY count DESC, label)::INTEGER AS place FROM g)
SELECT label, count, "group", place, "group" <> 'other' OR place <= 10 AS shown FROM r""")
def grouped_labels(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("count"))
    return Q.grouped_labels(counts, "label", "count", {"first": (["Brand#11", "Brand#12"], ["#5"]), "second": (["Brand#31"], [])}, "other", 10)


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part)
SELECT count(*) FILTER (len(list_filter(l, lambda x: x NOT IN ('red', 'blue'))) > 0)::BIGINT AS named, count(*) FILTER (len(list_filter(l, lambda x: x NOT IN ('red', 'blue'))) = 0)::BIGINT AS not_named, count(*) FILTER (list_has_any(l, ['red', 'blue']))::BIGINT AS unspecified, count(*)::BIGINT AS denominator FROM w""")
def named_coverage(spark: SparkSession, d: str) -> DataFrame:
    return Q.named_coverage(_part_words(spark, d), "words", ["red", "blue"])


@query("""
WITH c AS (SELECT o_orderstatus AS category, count(*) AS count FROM orders GROUP BY 1), n AS (SELECT count(*) AS denominator FROM orders)
SELECT 'Orders' AS section, 'Status' AS measure, category, count::BIGINT AS count, denominator, 100.0 * count / denominator AS percent, 'all orders' AS denominator_definition, 'single' AS response_type FROM c CROSS JOIN n""")
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    got = Q.single_response(table(spark, d, "orders"), "o_orderstatus").withColumnRenamed("label", "category")
    return long_rows(got, "Orders", "Status", "all orders", "single").select("section", "measure", "category", "count", "denominator", "percent", "denominator_definition", "response_type")


@query()
def shown_percentages(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "lineitem").groupBy("l_shipdate").agg(F.count("*").alias("count")).crossJoin(F.broadcast(table(spark, d, "lineitem").agg(F.count("*").alias("n"))))
    return got.select("l_shipdate", "count", percent(F.col("count").cast("double"), F.col("n").cast("double")).alias("percent"), shown_percent(F.col("count"), F.col("n")).alias("shown"))


QUERIES, ORACLE = query.queries, query.oracle
