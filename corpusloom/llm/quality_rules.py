"""Quality rules by distribution divergence, on built-in functions only.

Each document gives two histograms: code points by character class, and words by the common words of a language. The
references are the same histograms summed over all documents of a language. A document is kept if it passes the base
rules and, for some language, the Jensen-Shannon distances of both histograms stay under their thresholds; a histogram
with fewer entries than its guard isn't judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored, table

# Frequent function words of four languages.
COMMON_WORDS = {
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
}
CLASSES = ("lower", "space", "upper", "digit", "symbol", "mark", "other")
WORD_LIST = tuple(sorted({w for ws in COMMON_WORDS.values() for w in ws}))
SPACE = r"[\x20\x09-\x0D]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """Runs of other characters than the six ASCII white spaces."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def with_repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """df with the number of words in three-word windows that occur twice or more in the text, the first included.

    Windows are compared by 64-bit hashes. Sorting (hash, place) brings equal windows together; the places of those that
    have an equal neighbour are then sorted, and each adds the words that the place before it has not covered. Each step
    is a column of its own, so that no lambda computes an array again for each element.
    """
    w, n = F.col(words), F.size(words)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))))
    df = df.withColumn("__h", hashes)
    tagged = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), tagged))
    s = F.col("__s")
    same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    near = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    df = df.withColumn("__p", F.array_sort(F.filter(near, lambda p: p.isNotNull())))
    step = F.aggregate("__p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")))
    return df.withColumn(out, F.coalesce(step["n"], F.lit(0)).cast("long")).drop("__h", "__s", "__p")


def features(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with the base columns and the two histograms (__classes, __common: arrays of long; __n_tokens).

    The text is read once and nothing is shuffled.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = dropped(documents, *BASE, "base_failed", "kept", "__t", "__w", "__s1", "__c", "__l", "__lines", "__h", "__s", "__p", "__classes", "__common", "__n_tokens")
    df = df.withColumn("__t", t).withColumn("__w", words_of(F.col("__t")))
    # Class by class the text shrinks; each count is what one more class takes away.
    df = df.withColumn("__s1", F.regexp_replace("__t", r"\p{Ll}+", ""))
    left = [F.col("__t"), F.col("__s1")]
    for pattern in (SPACE + "+", r"\p{Lu}+", r"[0-9]+", r"[#*$%&|<>]+", r"[.,;:!?'\"()\-]+"):
        left.append(F.regexp_replace(left[-1], pattern, ""))
    sizes = [F.length(x).cast("long") for x in left]
    classes = [a - b for a, b in zip(sizes, sizes[1:])] + [sizes[-1]]
    letters = F.filter(F.split(F.lower("__t"), r"[^\p{L}]+"), lambda w: w != "")
    common = F.concat(F.lit(" "), F.array_join(F.filter("__l", lambda w: w.isin(*WORD_LIST)), "  "), F.lit(" "))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = with_repeat_words(df.withColumns({"__l": letters, "__lines": lines}), "__w", "n_repeat_words").withColumn("__c", common)
    counts = [((F.length("__c") - F.length(F.replace(F.col("__c"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in WORD_LIST]
    return df.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__classes": F.array(*classes),
            "__common": F.array(*counts),
            "__n_tokens": F.size("__l").cast("long"),
        }
    ).drop("__t", "__w", "__s1", "__c", "__l", "__lines")


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: 0.5 * part(a, (a + b) / 2) + 0.5 * part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def references(features_df: DataFrame, lang: str = "lang") -> DataFrame:
    """One row for each language of COMMON_WORDS that occurs: its two histograms over all its documents."""
    n, m = len(CLASSES), len(WORD_LIST)
    sums = [F.sum(F.element_at("__classes", i + 1)).alias(f"c{i}") for i in range(n)] + [F.sum(F.element_at("__common", i + 1)).alias(f"w{i}") for i in range(m)]
    got = features_df.filter(F.col(lang).isin(*COMMON_WORDS)).groupBy(F.col(lang).alias("__lang")).agg(*sums, F.sum("__n_tokens").alias("n"))
    return got.select("__lang", F.array(*(f"c{i}" for i in range(n))).alias("__rc"), F.array(*(f"w{i}" for i in range(m))).alias("__rw"), F.col("n").alias("__rn"))


def _word_histogram(counts: Column, n: Column, lang: str) -> Column:
    """Shares of the language's own common words, and of all other words."""
    own = [F.element_at(counts, WORD_LIST.index(w) + 1) for w in COMMON_WORDS[lang]]
    rest = n - sum(own[1:], own[0])
    return _shares(F.array(*own, rest), n)


def quality_rules(
    documents: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_chars: int = 200,
    max_class_distance: float = 0.28,
    min_tokens: int = 50,
    max_word_distance: float = 0.11,
    sampling_slack: float = 1.7,
) -> DataFrame:
    """documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed and kept.

    base_failed: fewer than min_words words, or over max_repeat_percent of the words lie in repeated three-word windows.
    class_distance and word_distance: those to the language whose sum is smallest; null where the histogram has fewer than
    min_chars code points or min_tokens words, or no language has a reference; a null distance doesn't reject. As the
    distance of a short text from its own language is mostly sampling error, which falls with the root of its length,
    the word threshold is max_word_distance + sampling_slack / sqrt(words). A null or
    empty text has zeros and fails the base rules; a null or unknown language only leaves a document out of the
    references. Repeated rows each get the same result; columns of these names are replaced. The language column, in
    upper or lower case, may be missing, then no document is judged by distance. Empty tables give empty tables.
    """
    named = [c for c in documents.columns if c.lower() == lang.lower()]
    with_lang = documents if named else documents.withColumn(lang, F.lit(None).cast("string"))
    lang = named[0] if named else lang
    f = stored(features(dropped(with_lang, "class_distance", "word_distance"), text), "quality")
    refs = references(f, lang).agg(F.map_from_entries(F.collect_list(F.struct("__lang", F.struct("__rc", "__rw", "__rn")))).alias("__refs"))
    df = f.crossJoin(F.broadcast(refs))  # one row: at most one entry for each of the four languages
    nc = _total(F.col("__classes"))
    judged = []
    for code in COMMON_WORDS:
        ref = F.col("__refs")[code]
        c = F.when(nc >= min_chars, js_distance(_shares(F.col("__classes"), nc), _shares(ref["__rc"], _total(ref["__rc"]))))
        w = F.when(F.col("__n_tokens") >= min_tokens, js_distance(_word_histogram(F.col("__common"), F.col("__n_tokens"), code), _word_histogram(ref["__rw"], ref["__rn"], code)))
        judged.append(F.when(ref.isNotNull(), F.struct((F.coalesce(c, F.lit(0.0)) + F.coalesce(w, F.lit(0.0))).alias("sum"), F.coalesce(c, F.lit(-1.0)).alias("c"), F.coalesce(w, F.lit(-1.0)).alias("w"))))
    df = df.withColumn("__best", F.least(*judged))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    c, w = F.col("__best")["c"], F.col("__best")["w"]
    fits = F.coalesce((c <= max_class_distance) & (w <= max_word_distance + sampling_slack / F.sqrt(F.greatest(F.col("__n_tokens"), F.lit(1)))), F.lit(True))
    return df.withColumns({"class_distance": F.when(c >= 0, c), "word_distance": F.when(w >= 0, w), "base_failed": base, "kept": ~base & fits}).drop("__classes", "__common", "__n_tokens", "__refs", "__best")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = quality_rules(docs)
    return got.select("doc_id", *BASE, "base_failed", "kept")


def _sql(docs: str = "documents") -> str:
    """The same decisions in DuckDB's SQL, for tables with one row for each doc_id."""
    space, mark = r"[\x20\x09-\x0D]", r"[.,;:!?''\"()\-]+"
    gone = [("t0", "coalesce(text, '')")] + [(f"t{i}", f"regexp_replace(t{i - 1}, '{p}', '', 'g')") for i, p in enumerate((r"\p{Ll}+", space + "+", r"\p{Lu}+", "[0-9]+", "[#*$%&|<>]+", mark), 1)]
    steps = ", ".join(f"s{i} AS (SELECT *, {e} AS {n} FROM {docs if i == 0 else f's{i - 1}'})" for i, (n, e) in enumerate(gone))
    classes = ", ".join([*(f"length(t{i}) - length(t{i + 1})" for i in range(6)), "length(t6)"])
    names = ", ".join(f"('{c}', '{w}')" for c, ws in COMMON_WORDS.items() for w in ws)
    part = "CASE WHEN {a} > 0 THEN 0.5 * {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
    js = f"sqrt(greatest(0, sum({part.format(a='p', b='q')} + {part.format(a='q', b='p')})))"
    return f"""
WITH {steps},
f AS (SELECT doc_id, lang, t0 AS t, regexp_extract_all(t0, '[^\\x20\\x09-\\x0D]+') AS w, regexp_extract_all(lower(t0), '\\p{{L}}+') AS l, list_filter(string_split(t0, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, [{classes}] AS c FROM s6),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM f WHERE len(w) >= 3), win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS d FROM pos),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, d) AS k FROM win) WHERE k > 1), cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS p FROM again) GROUP BY 1),
base AS (SELECT f.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM f LEFT JOIN cov ON f.doc_id = cov.doc_id),
names(code, word) AS (VALUES {names}), codes AS (SELECT DISTINCT code FROM names),
tok AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(l) AS word FROM f) WHERE word IN (SELECT word FROM names) GROUP BY 1, 2),
own AS (SELECT f.doc_id, lang, code, names.word, coalesce(n, 0) AS n, len(l) AS total FROM f CROSS JOIN names LEFT JOIN tok ON tok.doc_id = f.doc_id AND tok.word = names.word),
hist AS (SELECT doc_id, lang, code, word, n, total FROM own UNION ALL SELECT doc_id, lang, code, '', total - sum(n), total FROM own GROUP BY doc_id, lang, code, total),
wref AS (SELECT code, word, sum(n)::DOUBLE / greatest(sum(total), 1) AS q FROM hist WHERE lang = code GROUP BY 1, 2),
wd AS (SELECT doc_id, code, any_value(total) AS total, CASE WHEN any_value(total) >= 50 THEN {js} END AS d FROM (SELECT doc_id, code, total, n::DOUBLE / greatest(total, 1) AS p, q FROM hist JOIN wref USING (code, word)) GROUP BY 1, 2),
cls AS (SELECT doc_id, lang, unnest(c) AS n, generate_subscripts(c, 1) AS k, list_sum(c) AS total FROM f),
cref AS (SELECT lang AS code, k, sum(n)::DOUBLE / greatest(sum(total), 1) AS q FROM cls WHERE lang IN (SELECT code FROM codes) GROUP BY 1, 2),
cd AS (SELECT doc_id, code, CASE WHEN any_value(total) >= 200 THEN {js} END AS d FROM (SELECT doc_id, code, total, n::DOUBLE / greatest(total, 1) AS p, q FROM cls JOIN cref USING (k)) GROUP BY 1, 2),
best AS (SELECT cd.doc_id, arg_min((coalesce(cd.d, -1) <= 0.28) AND (coalesce(wd.d, -1) <= 0.11 + 1.7 / sqrt(greatest(total, 1))), coalesce(cd.d, 0) + coalesce(wd.d, 0)) AS fits FROM cd JOIN wd USING (doc_id, code) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(fits, true) AS kept FROM base LEFT JOIN best USING (doc_id)"""


ORACLE = {"op8_quality_rules": _sql()}
