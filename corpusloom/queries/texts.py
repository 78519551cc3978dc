"""Phrases, concepts, pairs and networks, candidate filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import phrase_text, thesaurus_text
from ..operators import graphs as N
from ..operators import phrases as P
from ..operators import screening as S
from .base import Registry, table

query = Registry()

#: A small dictionary and thesaurus over the words of the driver's texts.
DICTIONARY = {"of the": ["of the", "of-the"], "and": ["and"], "in": ["in"], "la": ["la"], "de la": ["de la"], "der": ["der"], "und": ["und"], "never": ["never such a phrase"]}
THESAURUS = {"english": ["the", "and", "of"], "french": ["le", "les"], "german": ["der", "die", "und"], "spanish": ["el", "los"], "none": ["no such word"]}
DOMAINS = {"article": r"\b(?:the|la|der)\b", "link": r"\b(?:and|et|und|y)\b", "place": r"\b(?:in|en)\b", "possession": r"\b(?:of|de|von)\b"}
POOLS = {"link": "NO_LINK", "place": "NO_PLACE", "possession": "NO_POSSESSION"}

# Word ends for a pattern language without look-around: what isn't a letter, digit or underscore, or an end of the text.
_B, _E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_GAP = r"[\s\-‐-―]+"


def _sql_pattern(variants: list[str]) -> str:
    return _B + "(" + "|".join(_GAP.join(v.replace("-", " ").split()) for v in variants) + ")" + _E


_HITS = "hits AS (SELECT doc_id, unnest([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{_sql_pattern(v)}') THEN '{k}' END" for k, v in DICTIONARY.items()) + "]) AS label FROM documents), found AS (SELECT * FROM hits WHERE label IS NOT NULL)"
_NAMES = "names(label) AS (VALUES " + ", ".join(f"('{k}')" for k in DICTIONARY) + ")"


def _found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", phrase_text("text").alias("text"))
    return P.hits(docs, "doc_id", ["text"], DICTIONARY)


@query(f"WITH {_HITS}, {_NAMES} SELECT names.label, count(found.doc_id)::BIGINT AS works, count(found.doc_id)::BIGINT AS text FROM names LEFT JOIN found ON names.label = found.label GROUP BY 1")
def phrase_freq(spark: SparkSession, d: str) -> DataFrame:
    return P.frequency(_found(spark, d), ["text"], list(DICTIONARY))


_ROLES = "conv AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN text END, chr(10) ORDER BY turn) AS asked, string_agg(CASE WHEN role <> 'user' THEN text END, chr(10) ORDER BY turn) AS told FROM conversations GROUP BY 1)"
_FIELDS = ", ".join(f"('{k}', '{_sql_pattern(v)}')" for k, v in DICTIONARY.items())


@query(f"""
WITH {_ROLES}, names(label, p) AS (VALUES {_FIELDS}), m AS (SELECT label, regexp_matches(lower(concat_ws(chr(10), coalesce(asked, ''), coalesce(told, ''))), p) AS w, regexp_matches(lower(coalesce(asked, '')), p) AS a, regexp_matches(lower(coalesce(told, '')), p) AS t FROM conv CROSS JOIN names)
SELECT label, count(*) FILTER (w)::BIGINT AS works, count(*) FILTER (w AND a)::BIGINT AS asked, count(*) FILTER (w AND t)::BIGINT AS told FROM m GROUP BY label""")
def phrase_fields(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    said = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond & F.col("text").isNotNull(), F.struct("turn", "text")))), lambda s: s["text"]), "\n")
    one = c.groupBy("conv_id").agg(said(F.col("role") == "user").alias("asked"), said(F.col("role") != "user").alias("told"))
    texts = one.select("conv_id", phrase_text("asked").alias("asked"), phrase_text("told").alias("told"))
    return P.frequency(P.hits(texts, "conv_id", ["asked", "told"], DICTIONARY), ["asked", "told"], list(DICTIONARY))


@query(f'WITH {_HITS} SELECT a.label AS "left", b.label AS "right", count(*)::BIGINT AS count FROM found a JOIN found b ON a.doc_id = b.doc_id AND a.label < b.label GROUP BY 1, 2')
def phrase_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.pairs(_found(spark, d), "doc_id")


_TABLE = f"""WITH {_HITS}, {_NAMES}, f AS (SELECT names.label, count(found.doc_id) AS n FROM names LEFT JOIN found ON names.label = found.label GROUP BY 1),
c AS (SELECT a.label AS l, b.label AS r, count(*) AS n FROM found a JOIN found b ON a.doc_id = b.doc_id AND a.label <= b.label GROUP BY 1, 2),
pairs AS (SELECT x.label AS "left", y.label AS "right", coalesce(c.n, 0)::BIGINT AS count, x.n::BIGINT AS left_works, y.n::BIGINT AS right_works, CASE WHEN x.n > 0 AND y.n > 0 THEN coalesce(c.n, 0) / sqrt(x.n::DOUBLE * y.n) END AS cosine FROM f x JOIN f y ON x.label <= y.label LEFT JOIN c ON c.l = x.label AND c.r = y.label)"""


@query(_TABLE + ' SELECT "left", "right", count, left_works, right_works, round(cosine, 8) AS cosine FROM pairs WHERE "left" <> "right"')
def pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    return P.pair_table(_found(spark, d), "doc_id", list(DICTIONARY)).withColumn("cosine", F.round("cosine", 8))


@query(_TABLE + ' SELECT "left", "right", count, left_works, right_works FROM pairs WHERE "left" <> "right" AND count > 0 AND left_works >= 5 AND right_works >= 5 AND "left" <> \'in\' AND "right" <> \'in\' ORDER BY count DESC, "left", "right" LIMIT 10')
def phrase_network(spark: SparkSession, d: str) -> DataFrame:
    t = P.pair_table(_found(spark, d), "doc_id", list(DICTIONARY))
    return P.network(t, 5, 10, ["in"]).drop("cosine")


@query(_TABLE + """, e AS (SELECT * FROM pairs WHERE "left" <> "right" AND count > 0 AND left_works >= 5 AND right_works >= 5 ORDER BY count DESC, "left", "right" LIMIT 10),
ends AS (SELECT "left" AS label, left_works AS works, count FROM e UNION ALL SELECT "right", right_works, count FROM e) SELECT label, works, count(*)::BIGINT AS degree, sum(count)::BIGINT AS strength FROM ends GROUP BY 1, 2""")
def network_nodes(spark: SparkSession, d: str) -> DataFrame:
    t = P.pair_table(_found(spark, d), "doc_id", list(DICTIONARY))
    return P.nodes(P.network(t, 5, 10))


@query(_TABLE + ', e AS (SELECT "left", "right", count, cosine FROM pairs WHERE "left" <> "right" AND count > 0), b AS (SELECT *, unnest(["left", "right"]) AS node FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cosine DESC, count DESC, "left", "right") AS k FROM b) SELECT DISTINCT "left", "right", count FROM r WHERE k <= 2 OR count >= 400')
def strongest_links(spark: SparkSession, d: str) -> DataFrame:
    t = P.pair_table(_found(spark, d), "doc_id", list(DICTIONARY)).filter("count > 0")
    return P.strongest(t, "cosine", "count", 2, 400).select("left", "right", "count")


@query(_TABLE + """, p(label, i) AS (VALUES ('und', 0), ('of the', 1), ('and', 2), ('der', 3), ('la', 4))
SELECT CASE WHEN a.i > b.i THEN "left" ELSE "right" END AS row, CASE WHEN a.i > b.i THEN "right" ELSE "left" END AS "column", count, round(cosine, 8) AS cosine, greatest(a.i, b.i)::INTEGER AS row_place, least(a.i, b.i)::INTEGER AS column_place FROM pairs JOIN p a ON "left" = a.label JOIN p b ON "right" = b.label""")
def lower_triangle(spark: SparkSession, d: str) -> DataFrame:
    t = P.pair_table(_found(spark, d), "doc_id", list(DICTIONARY), diagonal=True)
    return N.triangle(t, ["und", "of the", "and", "der", "la"])


@query("WITH " + _HITS + " SELECT documents.doc_id" + "".join(f""", coalesce(max((label = '{k}')::INTEGER), 0)::INTEGER AS "{k}" """ for k in DICTIONARY) + " FROM documents LEFT JOIN found ON documents.doc_id = found.doc_id GROUP BY 1")
def indicator_matrix(spark: SparkSession, d: str) -> DataFrame:
    return P.indicators(_found(spark, d), table(spark, d, "documents"), "doc_id", list(DICTIONARY))


_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[‐‑‒–—―−]', '-', 'g'), '[-_/]+', ' ', 'g'), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
_CONCEPTS = "concepts(concept, variant) AS (VALUES " + ", ".join(f"('{c}', '{v}')" for c, vs in THESAURUS.items() for v in vs) + ")"


@query(f"""WITH t AS (SELECT doc_id, ' ' || {_NORMAL} || ' ' AS text FROM documents), {_CONCEPTS}, m AS (SELECT doc_id, concept, variant FROM t JOIN concepts ON contains(text, ' ' || variant || ' '))
SELECT doc_id, concept, string_agg(variant, ';' ORDER BY variant) AS variants FROM m GROUP BY 1, 2""")
def concept_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", thesaurus_text("text").alias("text"))
    return P.concepts(docs, "doc_id", ["text"], THESAURUS).select("doc_id", "concept", F.array_join("variants", ";").alias("variants"))


@query(f"""WITH t AS (SELECT doc_id, ' ' || {_NORMAL} || ' ' AS text FROM documents), {_CONCEPTS}, m AS (SELECT DISTINCT doc_id, concept FROM t JOIN concepts ON contains(text, ' ' || variant || ' '))
SELECT c.concept AS label, count(m.doc_id)::BIGINT AS works FROM (SELECT DISTINCT concept FROM concepts) c LEFT JOIN m ON c.concept = m.concept GROUP BY 1""")
def concept_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", thesaurus_text("text").alias("text"))
    found = P.concepts(docs, "doc_id", ["text"], THESAURUS).withColumnRenamed("concept", "label")
    return P.frequency(found, [], list(THESAURUS))


_HIT = {k: "regexp_matches(lower(text), '" + _B + "(" + v.replace(r"\b", "").replace("(?:", "(") + ")" + _E + "')" for k, v in DOMAINS.items()}


@query("SELECT doc_id FROM documents WHERE " + " AND ".join(_HIT.values()))
def four_domain_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.candidates(table(spark, d, "documents").select("doc_id", "text"), ["text"], DOMAINS).select("doc_id")


@query(f"""SELECT doc_id, CASE WHEN NOT l THEN 'NO_LINK' WHEN NOT p THEN 'NO_PLACE' ELSE 'NO_POSSESSION' END AS pool FROM (SELECT doc_id, {_HIT['article']} AS a, {_HIT['link']} AS l, {_HIT['place']} AS p, {_HIT['possession']} AS o FROM documents) WHERE a AND l::INT + p::INT + o::INT = 2""")
def near_miss_pools(spark: SparkSession, d: str) -> DataFrame:
    return S.near_misses(table(spark, d, "documents").select("doc_id", "text"), ["text"], DOMAINS, "article", POOLS).select("doc_id", "pool")


QUERIES, ORACLE = query.queries, query.oracle
