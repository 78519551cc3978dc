"""The corpus pipeline: quality rules, line dedup, near-duplicates and packing over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import drop_between, stored, stored_so_far, table
from corpusloom.llm.line_dedup import dedup_lines
from corpusloom.llm.packing import pack, token_lengths
from corpusloom.llm.quality_rules import quality_rules
from corpusloom.llm.simhash import near_duplicates, similar_documents


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null, empty or short text goes; repeated rows stay or go together, extra columns stay, and an empty table stays empty.
    """
    return quality_rules(docs).filter("kept").select(docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of three lines or more that an earlier place has; n_chars follows the text.

    A null text stays null; repeated rows keep the same text, extra columns stay, and an empty table stays empty.
    """
    out = dedup_lines(docs)
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group.

    Rows that share an id stay or go together; groups without any id stay.
    """
    near = near_duplicates(docs.select("doc_id", "text"), words=3)
    heads = stored(near.filter("doc_id <=> component_id").select(F.col("doc_id").alias("head")).distinct(), "heads")
    # a merge join at any size, as in line dedup
    return docs.join(heads.hint("merge"), docs["doc_id"].eqNullSafe(heads["head"]), "left_semi")


def one_of_each_similar_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of texts whose five-word shingles are similar (0.8 or more).

    As one_of_each_group, which STAGES has, but for its links: see the README on which of the two is to stand there.
    """
    near = similar_documents(docs.select("doc_id", "text"))
    heads = stored(near.filter("doc_id <=> component_id").select(F.col("doc_id").alias("head")).distinct(), "heads")
    return docs.join(heads.hint("merge"), docs["doc_id"].eqNullSafe(heads["head"]), "left_semi")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of documents in length buckets and batches: doc_id, chunk, start, n_tokens, bucket, padded, batch and slot.

    A null or empty text is its begin and end; a null id is an id like others, repeated rows are packed as often as they
    occur, other columns are left, and an empty table stays empty.
    """
    import public_tokenizers

    return pack(token_lengths(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", without_repeated_passages),
    ("simhash_near_dedup", one_of_each_group),
    ("packing", packed),
]
#: Fingerprint links and boundaries found by dynamic programming are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; of what a stage has stored only its result is kept."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before = stored_so_far(spark)
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
            drop_between(spark, before, stored_so_far(spark) - 1)
    return docs
