"""Text normalisers and list handling, as column expressions; Unicode foldings that the JVM lacks are Arrow-batched UDFs."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that don't tell titles apart.
TITLE_STOPWORDS = ("a", "an", "and", "for", "in", "of", "on", "the", "to", "using", "with")
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi:")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space of any script at both ends; null becomes the empty string."""
    return F.coalesce(F.regexp_replace(col(c).cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def missing(c: str | Column) -> Column:
    """Null for null and for text without a visible character."""
    return F.when(strip(c) != "", strip(c))


def squeeze(c: str | Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"(?U)\s+", " "))


def exact_integer(c: str | Column, least: int | None = None) -> Column:
    """Long where the text is an integer in its shortest form and not under ``least``; else null."""
    s = strip(c)
    value = F.when(s.rlike(r"^(0|-?[1-9][0-9]*)$"), s.try_cast("long"))
    return value if least is None else F.when(value >= least, value)


def truth(c: str | Column) -> Column:
    return F.lower(strip(c)).isin("1", "true", "yes", "y")


def year(c: str | Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(r"^[0-9]{4}$"), s.cast("int"))


def utc_time(c: str | Column) -> Column:
    """Timestamp of ``YYYY-MM-DDTHH:MM:SSZ`` with a real calendar date; else null."""
    s = strip(c)
    shaped = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), s)
    return F.try_to_timestamp(shaped, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def _series(f):
    return lambda s: s.map(lambda x: f("" if x is None else x))


#: Java pattern of texts of ASCII and accented letters of Western Europe, which the JVM folds as Python does: none of them
#: has a compatibility form, and of each the case folding is the lower case (that of the sharp s isn't, which is left out).
WESTERN = r"\x00-\x7FÀ-Þà-ÿ"


def _folded(c: str | Column, kept: str, native: Column, udf) -> Column:
    """``native`` where a text has only the characters ``kept``; the others, and only they, go to the Arrow-batched function."""
    s = F.coalesce(col(c).cast("string"), F.lit(""))
    plain = s.rlike(rf"^[{kept}]*\z")
    return F.when(plain, native).otherwise(udf(F.when(~plain, s)))


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return _series(str.casefold)(s)


def casefold(c: str | Column) -> Column:
    return _folded(c, WESTERN, F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), _casefold)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return _series(lambda x: unicodedata.normalize("NFKC", x))(s)


def nfkc(c: str | Column) -> Column:
    """Compatibility form; null becomes the empty string."""
    return _folded(c, f"{WESTERN}ß", F.coalesce(col(c).cast("string"), F.lit("")), _nfkc)


def fold_plain(x: str) -> str:
    """Letters and digits of ASCII after compatibility decomposition, case folding and loss of accents; space between runs."""
    folded = unicodedata.normalize("NFKD", x.strip()).casefold()
    bare = "".join(ch for ch in folded if not unicodedata.combining(ch))
    return " ".join(re.findall("[a-z0-9]+", bare))


@F.pandas_udf(T.StringType())
def _linking_text(s: pd.Series) -> pd.Series:
    return _series(fold_plain)(s)


def linking_text(c: str | Column) -> Column:
    """fold_plain of a column."""
    s = F.coalesce(col(c).cast("string"), F.lit(""))
    return _folded(c, r"\x00-\x7F", F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")), _linking_text)


@F.pandas_udf(T.StringType())
def _phrase_text(s: pd.Series) -> pd.Series:
    return _series(lambda x: unicodedata.normalize("NFKC", re.sub(r"<[^>]+>", " ", html.unescape(x))).casefold())(s)


def phrase_text(c: str | Column) -> Column:
    """Character references decoded, tags to spaces, compatibility form, case folded."""
    return _folded(c, rf"{WESTERN}&&[^&<]", F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), _phrase_text)


def thesaurus_text(c: str | Column) -> Column:
    """Compatibility form, lower case, dashes, slashes and underscores to spaces, only a-z, 0-9 and single spaces left."""
    s = F.lower(nfkc(F.coalesce(col(c), F.lit(""))))
    s = F.regexp_replace(s, "[‐‑‒–—―−]", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[-_/]+", " "), r"[^a-z0-9\s]+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def doi(c: str | Column) -> Column:
    s = F.lower(strip(c))
    for p in DOI_PREFIXES:
        s = F.when(s.startswith(p), F.substring(s, len(p) + 1, 1 << 20)).otherwise(s)
    return F.regexp_replace(strip(s), r"\.+$", "")


def title_tokens(normal: str | Column) -> Column:
    """Different words of a normalised title, without stop words and single letters."""
    words = F.array_distinct(F.split(col(normal), " "))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*TITLE_STOPWORDS))


def author_tokens(authors: str | Column) -> Column:
    """Last name-like word of each author of a ``;`` list (of normalised names)."""
    last = F.transform(F.split(strip(authors), r"(?U)\s*;\s*"), lambda a: F.try_element_at(F.regexp_extract_all(a, F.lit(r"[a-z][a-z'-]+"), F.lit(0)), F.lit(-1)))
    return F.array_distinct(F.filter(last, lambda x: x.isNotNull()))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def gestalt(x: str, y: str) -> float:
    """Gestalt similarity of two texts; 0 if either is empty."""
    return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else 0.0


def gestalts(x: Sequence[str | None], y: Sequence[str | None]) -> np.ndarray:
    """gestalt of each two texts, for many at once.

    The longest matches of all pairs are found together, then those of what is left and right of each, and so on. As
    there, the one that begins first in x counts among matches as long as each other, then the one that begins first in y.
    """
    both = [(a, b) if a and b else ("", "") for a, b in zip(x, y)]
    sizes = np.array([len(t) for p in both for t in p], np.int64).reshape(-1, 2)
    ends = np.cumsum(sizes).reshape(-1, 2)
    codes = np.frombuffer("".join(t for p in both for t in p).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes.astype(np.uint8) if not len(codes) or codes.max() < 254 else codes
    matched = np.zeros(len(both), np.int64)
    # pair, and where its parts begin and how long they are, in x and y
    jobs = np.column_stack([np.arange(len(both)), ends - sizes, sizes])[sizes[:, 0] > 0]
    while len(jobs):
        jobs = jobs[np.lexsort((jobs[:, 4], jobs[:, 3]))]
        found, at = [], 0
        while at < len(jobs):
            some = jobs[at : at + max(1, (1 << 16) // int(jobs[at, 3:].max()))]
            found.append(_longest_matches(codes, *some[:, 1:].T))
            at += len(some)
        i, j, k = np.concatenate(found, axis=1)
        pair, a, b, n, m = jobs.T
        np.add.at(matched, pair, k)
        left, right = np.column_stack([pair, a, b, i, j]), np.column_stack([pair, a + i + k, b + j + k, n - i - k, m - j - k])
        jobs = np.concatenate([left[k > 0], right[k > 0]])
        jobs = jobs[(jobs[:, 3] > 0) & (jobs[:, 4] > 0)]
    return 2.0 * matched / np.maximum(sizes.sum(1), 1)


def _longest_matches(codes: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rows (i, j, k): the first longest match codes[a + i : a + i + k] == codes[b + j : b + j + k] of parts of n and m codes."""

    def padded(start: np.ndarray, size: np.ndarray, beyond: int) -> np.ndarray:
        at = np.arange(int(size.max()))[:, None]
        return np.where(at < size, codes[np.minimum(start + at, len(codes) - 1)], codes.dtype.type(beyond))

    top_code = np.iinfo(codes.dtype).max
    x, y = padded(a, n, top_code), padded(b, m, top_code - 1)
    kind = np.uint8 if max(len(x), len(y)) < 256 else np.int32
    run, following = np.zeros((len(y) + 1, len(a)), kind), np.zeros((len(y) + 1, len(a)), kind)
    longest, end = np.zeros(len(a), kind), np.zeros(len(a), np.int64)
    for i, row in enumerate(x):
        np.add(run[:-1], kind(1), out=following[1:])
        following[1:] *= y == row
        run, following = following, run
        top = run.max(0)
        end[top > longest] = i + 1
        np.maximum(longest, top, out=longest)
    k = longest.astype(np.int64)
    fits = np.ones(y.shape, bool)
    for t in range(int(k.max())):
        same = y[t:] == np.take_along_axis(x, np.minimum(end - k + t, len(x) - 1)[None], 0)
        fits[: len(y) - t] &= same | (t >= k)
        fits[len(y) - t :] &= t >= k
    return np.stack([end - k, fits.argmax(0), k])


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt similarity of two texts; 0 if either is empty."""
    number: dict[tuple[str, str], int] = {}
    of = [number.setdefault(p, len(number)) for p in zip(a, b)]
    return pd.Series(gestalts(*zip(*number))[of] if of else [], dtype=float)


def title_similarity(a: str | Column, b: str | Column) -> Column:
    """Larger of gestalt similarity and Jaccard similarity of two normalised titles."""
    return F.greatest(sequence_ratio(a, b), F.when((col(a) != "") & (col(b) != ""), jaccard(title_tokens(a), title_tokens(b))).otherwise(F.lit(0.0)))


def split_list(c: str | Column, sep: str = ";") -> Column:
    """Trimmed items of a delimited text; blank ones are left out."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), re.escape(sep)), strip), lambda x: x != "")


def list_faults(c: str | Column, sep: str = ";") -> Column:
    """Null, or what is wrong with a delimited list: ``blank item`` or ``repeated item``."""
    items = F.transform(F.split(col(c), re.escape(sep)), strip)
    asked = missing(c).isNotNull()
    return F.when(asked & F.exists(items, lambda x: x == ""), F.lit("blank item")).when(asked & (F.size(F.array_distinct(items)) < F.size(items)), F.lit("repeated item"))


def first_spellings(items: str | Column) -> Column:
    """Squeezed items that differ in more than case, the first spelling of each, in their order."""
    clean = F.filter(F.transform(items, squeeze), lambda x: x != "")
    keys = F.transform(clean, F.lower)
    return F.filter(clean, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def unique_texts(items: str | Column) -> Column:
    """first_spellings, sorted by folded text, then text."""
    return F.transform(F.array_sort(F.transform(first_spellings(items), lambda x: F.struct(F.lower(x).alias("k"), x.alias("x")))), lambda s: s["x"])


def url_list(urls: Column, doi_value: Column) -> Column:
    """Addresses in order of first occurrence, the one of the DOI added."""
    made = F.when(doi(doi_value) != "", F.array(F.concat(F.lit("https://doi.org/"), doi(doi_value)))).otherwise(F.array().cast("array<string>"))
    return first_spellings(F.concat(urls, made))


def by_rank(items: str | Column, ranks: Sequence[str]) -> Column:
    """Items by a fixed order of labels; others follow in alphabetical order."""
    order = F.array(*(F.lit(r) for r in ranks))
    place = lambda x: F.when(F.array_position(order, x) > 0, F.array_position(order, x)).otherwise(F.lit(len(ranks) + 1))
    return F.transform(F.array_sort(F.transform(col(items), lambda x: F.struct(place(x).alias("r"), x.alias("x")))), lambda s: s["x"])


def display(c: str | Column, special: dict[str, str] | None = None) -> Column:
    """Reader-facing label: a special one, else underscores to spaces, a capital first if there is none at all."""
    s = F.trim(F.regexp_replace(col(c), "_", " "))
    plain = F.when(s.rlike(r"\p{Lu}"), s).otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 20))))
    if not special:
        return plain
    table = F.create_map(*(F.lit(x) for kv in special.items() for x in kv))
    return F.coalesce(F.try_element_at(table, col(c)), plain)


def coded(c: str | Column, names: dict[str, str]) -> Column:
    """``Name (CODE)`` for known codes, else the code; codes in capitals."""
    code = F.upper(strip(c))
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.concat(F.try_element_at(table, code), F.lit(" ("), code, F.lit(")")), code)


def source_key(source_id: str, issn: str, name: str) -> Column:
    """Struct (key, display) of a source: by id, else by linking ISSN, else by folded name, else unknown."""
    i, s, n = missing(source_id), missing(issn), missing(name)
    shown = F.coalesce(n, i, s, F.lit("Unknown source"))
    folded = F.lower(squeeze(nfkc(F.coalesce(n, F.lit("")))))
    key = F.when(i.isNotNull(), F.concat(F.lit("id:"), i)).when(s.isNotNull(), F.concat(F.lit("issn:"), s)).when(n.isNotNull(), F.concat(F.lit("name:"), folded)).otherwise(F.lit("unknown"))
    return F.struct(key.alias("key"), shown.alias("display"))


def phrase_pattern(variants: Sequence[str]) -> str:
    """Java pattern of whole phrases in any of their spellings; white space and hyphens between words are alike."""
    gap = r"[\s\-‐-―]+"
    each = [gap.join(re.escape(w) for w in re.split(r"[\s\-‐-―]+", v.strip().casefold()) if w) for v in variants]
    return r"(?iU)(?<!\w)(?:" + "|".join(each) + r")(?!\w)"


def variant_pattern(variant: str) -> str:
    """Java pattern of a normalised thesaurus variant between other characters than a-z and 0-9."""
    return r"(?<![a-z0-9])" + r"\s+".join(re.escape(w) for w in variant.split()) + r"(?![a-z0-9])"
