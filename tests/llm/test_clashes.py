"""Every operator and pipeline stage with input that has the names it uses itself, in both cases."""

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import html_text, line_dedup, lm, packing, pieces, quality_rules, simhash, topk, url_rules

from .conftest import ROWS

NAMES = (
    "id", "hash", "covered", "key", "lines", "places", "ranges", "first", "last", "h1", "h2", "one", "other", "v", "u", "uh", "up", "host_", "fp", "root", "node", "least", "component", "bucket_", "left", "hot",
    "row", "w", "c", "t", "r", "b", "k", "ids_", "base", "known", "n", "i", "x", "s", "count", "refs", "total", "own", "said", "layout", "reference", "content", "template", "usual", "start_", "at", "range", "kind", "is_q", "bq", "bx",
)


@pytest.fixture(scope="module", params=[str, str.upper])
def clashing(request, odd):
    have = {c.lower() for c in odd.columns}
    return odd.withColumns({request.param(n): F.lit("mine") for n in NAMES if n not in have})


def kept(df, before, gone=()):
    rows = df.collect()
    mine = [c for c in before.columns if c.lower() in NAMES and c.lower() not in gone]
    assert len(mine) > 40 and all(r[c] == "mine" for r in rows for c in mine)
    return rows


def test_documents(clashing, piece_path, word_path):
    assert len(kept(line_dedup.dedup_lines(clashing), clashing)) == len(ROWS)
    assert len(kept(quality_rules.quality_rules(clashing), clashing)) == len(ROWS)
    assert len(kept(simhash.near_duplicates(clashing), clashing)) == len(ROWS)
    assert len(kept(simhash.similar_documents(clashing), clashing)) == len(ROWS)
    assert len(kept(pieces.encode_pieces(clashing, piece_path), clashing)) == len(ROWS)
    assert len(kept(packing.token_lengths(clashing, piece_path), clashing)) == len(ROWS)
    assert len(kept(packing.pack(packing.token_lengths(clashing, piece_path)), clashing)) >= len(ROWS)
    assert lm.score_documents(clashing, piece_path).count() == len(ROWS)


def test_languages_in_upper_case_are_judged(odd):
    some = quality_rules.quality_rules(odd.withColumn("text", F.repeat(F.lit("the of and words to read in a text that is plain "), 9)))
    upper = quality_rules.quality_rules(odd.withColumn("text", F.repeat(F.lit("the of and words to read in a text that is plain "), 9)).withColumnRenamed("lang", "LANG"))
    pick = lambda df: sorted((str(r["doc_id"]), r["word_distance"]) for r in df.collect())
    assert pick(some) == pick(upper) and all(d is not None for _, d in pick(upper)) and "LANG" in upper.columns


def test_pages(clashing):
    pages = clashing.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), "text", *(c for c in clashing.columns if c.lower() in NAMES)).withColumnRenamed("text", "html")
    assert len(kept(html_text.extract_text(pages), pages)) == len(ROWS)
    rules = pages.sparkSession.createDataFrame(list(url_rules.RULES), "verdict string, host string, path string")
    for shipped in (1 << 20, 1):
        assert len(kept(url_rules.filter_urls(pages.drop("html"), rules, shipped_bytes=shipped), pages)) == len(ROWS)


def test_vectors(clashing):
    v = clashing.filter("doc_id is not null").select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1), F.col("doc_id")).alias("vector"), *(c for c in clashing.columns if c.lower() in NAMES))
    assert topk.top_k(v, v.filter("vec_id = 1"), 3).count() == 3


def test_stages(clashing, spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = clashing.withColumn("text", F.when(F.col("doc_id") < 7, F.concat("text", F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("the w"), (i * F.col("doc_id")).cast("string"))), " "))).otherwise(F.col("text")))
    n = len(ROWS)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        rows = kept(docs, clashing)
        assert docs.columns == clashing.columns and 0 < len(rows) <= n
        n = len(rows)
    assert pipeline.STAGES[-1][1](spark, docs, "").count() >= n
    similar = pipeline.one_of_each_similar_group(spark, clashing, "")
    assert similar.columns == clashing.columns and len(kept(similar, clashing)) < len(ROWS)
    for name, stage in [*pipeline.STAGES, ("", pipeline.one_of_each_similar_group)]:
        assert stage(spark, clashing.limit(0), "").count() == 0


def test_the_pipeline_keeps_results_only(spark):
    import os

    from corpusloom.llm import common

    pipeline = pytest.importorskip("corpus_pipeline")
    root = common.local_path(common.shared_root(spark))
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    n = pipeline.run(spark, "/root/testdata/sf0.001").count()
    tags = [f.rsplit("-", 1)[0] for f in set(os.listdir(root)) - before]
    assert n > 0 and sorted(tags) == sorted([*(name for name, _ in pipeline.STAGES[:-1]), "lengths"])
