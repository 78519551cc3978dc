"""Families and pairs of records, samples, overlays, rules, digests and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import linking_text, split_list
from ..operators import graphs as N
from ..operators import linkage as L
from ..operators import overlay as O
from ..operators import sampling as M
from ..operators import screening as S
from ..sources import sinks as K
from .base import Registry, table

query = Registry()

_NORMAL = r"trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g'))"


@query("""
WITH f AS (SELECT text, min(doc_id) AS family, count(*) AS family_size, 'VWF-' || substr(sha256(string_agg(doc_id::VARCHAR, chr(0) ORDER BY doc_id::VARCHAR)), 1, 24) AS family_id FROM documents GROUP BY 1)
SELECT doc_id, family, family_size::BIGINT AS family_size, family_id, family AS preferred_key FROM documents JOIN f USING (text)""")
def exact_dup_families(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("t"))
    first = docs.groupBy("t").agg(F.min("doc_id").alias("family"))
    members = docs.join(first, "t").select("doc_id", "family", (F.col("doc_id") == F.col("family")).alias("preferred"))
    return L.families(members, "family", "doc_id", "preferred").select("doc_id", "family", "family_size", "family_id", "preferred_key")


@query("SELECT source, 'S-' || substr(sha256(string_agg(DISTINCT lang, chr(0) ORDER BY lang)), 1, 24) AS set_id FROM documents GROUP BY 1")
def stable_family_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(K.set_id("S-", F.collect_set("lang")).alias("set_id"))


_SETS = r"""WITH words AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents), s AS (SELECT doc_id, w FROM words WHERE w <> ''), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS k FROM s a JOIN s b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2), pairs AS (SELECT l, r, k / (x.n + y.n - k)::DOUBLE AS similarity FROM c JOIN n x ON l = x.doc_id JOIN n y ON r = y.doc_id WHERE k / (x.n + y.n - k)::DOUBLE >= 0.8)"""


def _words(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != ""), 0.8


@query(_SETS + ' SELECT l AS "left", r AS "right", round(similarity, 9) AS similarity FROM pairs')
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.shared_token_pairs(*_words(spark, d)).withColumn("similarity", F.round("similarity", 9))


@query(_SETS.replace("WITH words", "WITH RECURSIVE words") + ", e AS (SELECT l AS a, r AS b FROM pairs UNION ALL SELECT r, l FROM pairs), reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a")
def components(spark: SparkSession, d: str) -> DataFrame:
    return N.connected(L.similar_classes(*_words(spark, d)).select("left", "right"))


@query(_SETS + r""", sets AS (SELECT doc_id, list_sort(list(w)) AS t FROM s GROUP BY 1), class AS (SELECT t, min(doc_id) AS id FROM sets GROUP BY t)
SELECT l AS "left", r AS "right", round(similarity, 9) AS similarity FROM pairs WHERE l IN (SELECT id FROM class) AND r IN (SELECT id FROM class) UNION ALL SELECT id, doc_id, 1.0 FROM sets JOIN class USING (t) WHERE id <> doc_id""")
def near_dup_classes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of equal word sets, and each copy with its class."""
    return L.similar_classes(*_words(spark, d)).withColumn("similarity", F.round("similarity", 9))


@query()
def near_dup_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    return near_dup_pairs(spark, d)


@query()
def components_all(spark: SparkSession, d: str) -> DataFrame:
    """components: copies are linked through their class, which joins the same documents as all pairs do."""
    return components(spark, d)


@query()
def version_candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("paper_id"), F.substring("text", 1, 60).alias("title"), F.concat_ws("; ", "source", "lang").alias("authors"), (F.lit(2020) + F.col("doc_id") % 5).cast("string").alias("year")
    )
    flags = docs.select(F.col("paper_id").alias("a"), (F.col("paper_id") + 1).alias("b")).filter("a % 50 = 0")
    return L.version_pairs(docs, flags).withColumns({"shared_authors": F.array_join("shared_authors", ";"), "reasons": F.array_join("reasons", ";")})


@query("""
SELECT least(l_suppkey, l_partkey % 100 + 1) AS "left", greatest(l_suppkey, l_partkey % 100 + 1) AS "right", string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1, 2""")
def version_edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 100 + 1).alias("other"), "l_returnflag")
    return L.edges(li, "l_suppkey", "other", "l_returnflag").withColumn("flags", F.array_join("flags", ";"))


@query("""
SELECT doc_id, lang, sha256('seed-' || lang || '|' || doc_id) AS pool_hash, k::INTEGER AS pool_rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed-' || lang || '|' || doc_id), doc_id) AS k FROM documents) WHERE k <= 20""")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return M.sample(table(spark, d, "documents").select("doc_id", "lang"), "seed", "lang", "doc_id", 20)


@query("""
SELECT doc_id, lang, k::INTEGER AS pool_rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed-' || lang || '|' || doc_id), doc_id) AS k FROM documents) WHERE k BETWEEN 21 AND 30""")
def sample_expansion(spark: SparkSession, d: str) -> DataFrame:
    ranked = M.ranked_pools(table(spark, d, "documents").select("doc_id", "lang"), "seed", "lang", "doc_id")
    return M.expansion(ranked, ranked.filter("pool_rank <= 20"), "doc_id", 30).select("doc_id", "lang", "pool_rank")


@query("""
WITH s AS (SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed-' || lang || '|' || doc_id), doc_id) AS k FROM documents) WHERE k <= 20)
SELECT doc_id, o::INTEGER AS audit_order, 'H' || lpad(o::VARCHAR, 3, '0') AS audit_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('seed-ORDER|' || doc_id), doc_id) AS o FROM s)""")
def blinded_order(spark: SparkSession, d: str) -> DataFrame:
    s = M.sample(table(spark, d, "documents").select("doc_id", "lang"), "seed", "lang", "doc_id", 20)
    return M.blinded(s, "seed", "doc_id").select("doc_id", "audit_order", "audit_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)::BIGINT AS row_number, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 + 1 AS batch FROM orders")
def numbered_batches(spark: SparkSession, d: str) -> DataFrame:
    return M.batches(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_custkey, o_orderkey)::BIGINT AS row_number, (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) // 25 + 1 AS batch FROM orders")
def numbered_payload(spark: SparkSession, d: str) -> DataFrame:
    return M.batches(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey", "o_orderkey"], 25)


@query()
def difficult_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 11 == 0).alias("missing"), (F.col("toxic") == 1).alias("uncertain"), (F.col("quality") == 0).alias("disagree"))
    return M.difficult(rows, "seed", "doc_id")


@query("SELECT n_nationkey, sha256(concat_ws(chr(0), n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR)) AS row_sha256 FROM nation")
def row_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", K.joined_digest(["n_nationkey", "n_name", "n_regionkey"]).alias("row_sha256"))


@query("""SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":"' || n_nationkey || '","n_regionkey":"' || n_regionkey || '"}') AS row_sha256 FROM nation""")
def row_hash_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", K.row_digest(["n_nationkey", "n_name", "n_regionkey"]).alias("row_sha256"))


@query("""
SELECT 'nations:' || lpad((row_number() OVER (ORDER BY n_name) + 1)::VARCHAR, 6, '0') AS claim_id, 'nations' AS "table", (row_number() OVER (ORDER BY n_name) + 1)::INTEGER AS row_number, n_regionkey::VARCHAR AS reported_value, sha256(concat_ws(chr(0), n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR)) AS row_sha256,
 (SELECT sha256(string_agg(r_name || ':' || sha256(r_name), chr(0) ORDER BY r_name || ':' || sha256(r_name))) FROM region) AS bundle_sha256 FROM nation""")
def claim_register(spark: SparkSession, d: str) -> DataFrame:
    bundle = K.bundle_digest(table(spark, d, "region").select(F.col("r_name").alias("role"), F.sha2("r_name", 256).alias("sha256"))).first()[0]
    return K.claims(table(spark, d, "nation"), "nations", ["n_name"], ["n_regionkey"], bundle)


_COPY = "copy AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer)"


def _copy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    other = c.withColumns({"c_name": F.when(F.col("c_custkey") % 10 == 0, F.upper("c_name")).otherwise(F.col("c_name")), "c_mktsegment": F.when(F.col("c_custkey") % 15 != 0, F.col("c_mktsegment"))})
    return c, other


@query(f"""WITH {_COPY} SELECT c_custkey, 'c_name' AS field, a.c_name AS "left", b.c_name AS "right" FROM customer a JOIN copy b USING (c_custkey) WHERE a.c_name IS DISTINCT FROM b.c_name UNION ALL SELECT c_custkey, 'c_mktsegment', a.c_mktsegment, b.c_mktsegment FROM customer a JOIN copy b USING (c_custkey) WHERE a.c_mktsegment IS DISTINCT FROM b.c_mktsegment""")
def cell_diff(spark: SparkSession, d: str) -> DataFrame:
    return O.differences(*_copy(spark, d), "c_custkey", ["c_name", "c_mktsegment"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'Corrected ' || c_custkey ELSE c_name END AS c_name, CASE WHEN c_custkey % 20 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def correction_overlay(spark: SparkSession, d: str) -> DataFrame:
    c = _copy(spark, d)[0]
    fix = lambda k, f, new: c.filter(f"c_custkey % {k} = 0").select("c_custkey", F.lit(f).alias("field"), F.col(f).alias("expected_old"), new.alias("new_value"))
    fixes = fix(10, "c_name", F.concat(F.lit("Corrected "), F.col("c_custkey").cast("string"))).union(fix(20, "c_mktsegment", F.lit("OTHER")))
    return O.corrected(c, fixes, "c_custkey", ["c_name", "c_mktsegment"])


@query(f"WITH {_COPY} SELECT a.c_custkey, a.c_name, b.c_mktsegment FROM customer a JOIN copy b USING (c_custkey)")
def column_precedence(spark: SparkSession, d: str) -> DataFrame:
    c, other = _copy(spark, d)
    return O.precedence(c, other, "c_custkey", ["c_mktsegment"])


@query("SELECT c_name AS name, c_nationkey AS nation, coalesce(c_mktsegment, '') AS segment, 'customers' AS source_corpus FROM customer UNION ALL SELECT s_name, s_nationkey, '', 'suppliers' FROM supplier")
def union_provenance(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return L.integrate(c, s, ("customers", "suppliers"))


@query("""
SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_quantity > 49 THEN 'large' END, CASE WHEN l_discount >= 0.1 THEN 'discount' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'returned while open' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem""")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    rules = {"large": F.col("l_quantity") > 49, "discount": F.col("l_discount") >= 0.1, "returned while open": (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")}
    return S.violations(table(spark, d, "lineitem"), rules, ["l_orderkey", "l_linenumber"])


@query("""
WITH f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY 1), w AS (SELECT d.*, doc_id = first AS alone FROM documents d JOIN f USING (text))
SELECT cohort, lang, count(*)::BIGINT AS count FROM (SELECT 'all' AS cohort, lang FROM w UNION ALL SELECT 'without copies', lang FROM w WHERE alone UNION ALL SELECT 'long', lang FROM w WHERE n_chars > 1000) GROUP BY 1, 2""")
def cohort_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("t"))
    first = docs.groupBy("t").agg(F.min("doc_id").alias("first"))
    w = docs.join(first, "t")
    return O.cohorts(w, {"all": F.lit(True), "without copies": F.col("doc_id") == F.col("first"), "long": F.col("n_chars") > 1000}).groupBy("cohort", "lang").agg(F.count("*").alias("count"))


@query("""
(SELECT DISTINCT c_nationkey AS nation, 'first' AS side FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 20)) UNION ALL (SELECT DISTINCT s_nationkey, 'second' FROM supplier WHERE s_suppkey <= 20 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer))""")
def set_differences(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").filter("s_suppkey <= 20").select(F.col("s_nationkey").alias("nation"))
    return O.set_faults(c, s, ["nation"])


@query("""
WITH a AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1)
SELECT nation, coalesce(a.n, 0)::BIGINT AS first, coalesce(b.n, 0)::BIGINT AS second FROM a FULL JOIN b USING (nation) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_differences(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    return O.multiset_faults(c, table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), ["nation"])


@query("""
WITH a AS (SELECT string_agg(doc_id::VARCHAR, chr(0) ORDER BY doc_id::VARCHAR) AS m FROM documents GROUP BY text), b AS (SELECT string_agg(doc_id::VARCHAR, chr(0) ORDER BY doc_id::VARCHAR) AS m FROM documents GROUP BY text, lang, doc_id % 2)
SELECT replace(coalesce(x.m, y.m), chr(0), ';') AS members, (x.m IS NOT NULL)::BIGINT AS in_first, (y.m IS NOT NULL)::BIGINT AS in_second FROM a x FULL JOIN b y ON x.m = y.m WHERE (x.m IS NULL) <> (y.m IS NULL)""")
def partition_differences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("f"), F.sha2(F.concat_ws("\0", "text", "lang", (F.col("doc_id") % 2).cast("string")), 256).alias("g"))
    got = L.same_partition(docs.select("doc_id", "f"), docs.select("doc_id", F.col("g").alias("f")), "f", "doc_id")
    return got.withColumn("members", F.replace("members", F.lit("\0"), F.lit(";")))


@query("SELECT p_partkey, string_agg(w, ';' ORDER BY CASE w WHEN 'red' THEN 1 WHEN 'blue' THEN 2 ELSE 3 END, w) AS words FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def ranked_labels(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import by_rank

    return table(spark, d, "part").select("p_partkey", F.array_join(by_rank(split_list("p_name", " "), ["red", "blue"]), ";").alias("words"))


@query(f"SELECT doc_id, {_NORMAL} AS plain FROM documents")
def linking_normal_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", linking_text("text").alias("plain"))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 = 0")
def semi_routed(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    kept = o.join(c, "o_custkey", "left_semi").withColumn("source_corpus", F.lit("customers"))
    return L.routed(kept, {"customers": c}, "source_corpus", "o_custkey", ["c_name"]).select("o_orderkey", "o_custkey", "c_name")


QUERIES, ORACLE = query.queries, query.oracle
