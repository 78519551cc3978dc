"""Countries and authors of works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import share
from ..functions.text import missing, nfkc, squeeze

AUTHORS = "array<struct<author_id:string,author_name:string,orcid:string,institution_ids:array<string>,countries:array<string>>>"


def parsed_authors(json: str | Column) -> Column:
    """Authors from their JSON; bad JSON fails."""
    return F.from_json(json, AUTHORS, {"mode": "FAILFAST"})


def work_countries(authors: str) -> Column:
    """Different countries of the authors that have an id or a name."""
    credited = F.filter(authors, lambda a: missing(a["author_id"]).isNotNull() | missing(a["author_name"]).isNotNull())
    codes = F.flatten(F.transform(credited, lambda a: F.coalesce(a["countries"], F.array().cast("array<string>"))))
    return F.array_distinct(F.filter(F.transform(codes, lambda c: F.upper(F.trim(c))), lambda c: c != ""))


def country_counts(works: DataFrame, countries: str) -> DataFrame:
    """country, whole (works), fractional (each work shared equally by its countries), covered (works with any)."""
    own = works.select(F.array_distinct(countries).alias("c")).filter(F.size("c") > 0)
    n = own.agg(F.count("*").alias("covered"))
    each = own.select(F.explode("c").alias("country"), (F.lit(1.0) / F.size("c")).alias("w"))
    got = each.groupBy("country").agg(F.count("*").alias("whole"), F.round(F.sum("w"), 6).alias("fractional"))
    return got.crossJoin(F.broadcast(n))  # one row


def country_shares(works: DataFrame, countries: str) -> DataFrame:
    """country_counts with both denominators, covered works and all works, percentages under each, and a row (country null) for works without a country."""
    n = works.agg(F.count("*").alias("works"))
    got = country_counts(works, countries).crossJoin(F.broadcast(n))  # one row
    none = works.select(F.when(F.size(F.coalesce(F.col(countries), F.array().cast("array<string>"))) > 0, 1).otherwise(0).alias("c")).agg((F.count("*") - F.coalesce(F.sum("c"), F.lit(0))).alias("whole"), F.coalesce(F.sum("c"), F.lit(0)).alias("covered"), F.count("*").alias("works"))
    blank = none.select(F.lit(None).cast("string").alias("country"), "whole", F.lit(None).cast("double").alias("fractional"), "covered", "works")
    both = got.select("country", "whole", "fractional", "covered", "works").unionByName(blank)
    return both.withColumns({"percent_of_covered": F.when(F.col("country").isNotNull(), share(F.col("whole"), F.col("covered"))), "percent_of_works": share(F.col("whole"), F.col("works"))})


def collaboration(works: DataFrame, countries: str) -> DataFrame:
    """One row: works with several countries, works with any, all works."""
    size = F.size(F.array_distinct(countries))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return works.agg(n(size > 1).alias("international"), n(size > 0).alias("covered"), F.count("*").alias("works"))


def identities(works: DataFrame, key: str, authors: str) -> DataFrame:
    """(work, identity, author_name) of each author that has an id or a name.

    An author with an id is that id. One without takes the id of the authors of the same work who have the same name,
    ORCID and institutions, if that is one id only; else a name-only identity of the work.
    """
    a = works.select(F.col(key).alias("work"), F.posexplode(authors).alias("place", "a"))
    institutions = F.array_join(F.array_sort(F.array_distinct(F.coalesce("a.institution_ids", F.array().cast("array<string>")))), ";")
    name = F.lower(squeeze(nfkc(F.coalesce("a.author_name", F.lit("")))))
    rows = a.select("work", "place", missing("a.author_id").alias("id"), missing("a.author_name").alias("author_name"), F.concat_ws("\0", name, F.lower(F.coalesce("a.orcid", F.lit(""))), institutions).alias("sign"))
    rows = rows.filter("id is not null or author_name is not null")
    one = rows.filter("id is not null").groupBy("work", "sign").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least = most").select("work", "sign", F.col("least").alias("borrowed"))
    got = rows.join(one, ["work", "sign"], "left")
    alone = F.concat(F.lit("name-only:"), F.col("work").cast("string"), F.lit(":"), F.substring(F.sha2("sign", 256), 1, 16))
    known = F.lower(F.regexp_extract(F.coalesce("id", "borrowed"), r"([^/]+)/?$", 1))
    return got.select("work", F.coalesce(F.concat(F.lit("openalex:"), known), alone).alias("identity"), "author_name", "place")


def productivity(links: DataFrame, work: str = "work", identity: str = "identity") -> DataFrame:
    """identity, works: different works of each identity."""
    return links.select(work, identity).distinct().groupBy(identity).agg(F.count("*").alias("works"))


def bands(counts: DataFrame, works: str = "works", last: int = 4) -> DataFrame:
    """band (1, 2, ... and last or more) and how many identities are in it, zeros included."""
    names = [str(i) for i in range(1, last)] + [f">={last}"]
    spine = counts.sparkSession.createDataFrame([(n,) for n in names], "band string")
    got = counts.groupBy(F.when(F.col(works) >= last, names[-1]).otherwise(F.col(works).cast("string")).alias("band")).agg(F.count("*").alias("n"))
    return spine.join(got, "band", "left").select("band", F.coalesce("n", F.lit(0)).cast("long").alias("identities"))
