"""Quality rules by distribution divergence.

Base rules count words, symbols, repeated lines and repeated word windows. The method then
compares two histograms of a document with the reference of its language by the Jensen-Shannon
distance (0 to 1): the character classes, and the common words of the language with all other
words as one class. References are the summed histograms of all documents of a language that
pass the base rules. A document is judged by a histogram only when it is long enough; it is
kept unless the base rules fail or one of the distances exceeds its bound.

The texts are read once, by array functions inside one projection without a shuffle; the
counts (a narrow table) are kept, summed up per language, and joined to the references. The
windows of a document are sorted by a 64-bit hash and compared by their words. Only DataFrame
functions are used.

Edge cases: a null or empty text has no words and fails the base rules; documents of an unknown
or null language are compared by character classes with the reference of all documents; repeated
rows are judged each; a language whose documents all fail the base rules has no reference and
rejects none; a text of any length is counted whole, in one row; no documents give no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import kept, text_words

# Frequent function words of four languages.
COMMON_WORDS = {
    "de": "der die das und in zu den von ist mit nicht ein eine für auf sich".split(),
    "en": "the of and to in a is that it was for on are with as be".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
    "fr": "de la le et les des en un une du que est dans qui par pour".split(),
}
SYMBOLS = r"[^#*$%&|<>]+"
CLASSES = {  # what is removed so that the class is left
    "lower": r"[^\p{Ll}]+",
    "upper": r"[^\p{Lu}]+",
    "digit": r"[^0-9]+",
    "space": r"[^\x20\x09-\x0D]+",
    "stop": r"[^.,;:!?'\"()-]+",
    "symbol": r"[^#$%&*+/<=>@\[\\\]^_`{|}~]+",
}
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
GUARD_CHARS, GUARD_WORDS = 200, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.3


def _left(text: Column, removed: str) -> Column:
    return F.char_length(F.regexp_replace(text, removed, "")).cast("long")


def _windows(words: Column) -> Column:
    """The 3-word windows as sortable structs: hash, words, place."""
    one = lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"),
        F.get(words, i).alias("a"),
        F.get(words, i + 1).alias("b"),
        F.get(words, i + 2).alias("c"),
        i.alias("p"),
    )
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(places, one))


def _repeated(sorted_windows: Column) -> Column:
    """Words in windows that equal another window of the text."""
    same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    pair = lambda x, y: F.when(same(x, y), F.array(x["p"], y["p"]))
    after = F.slice(sorted_windows, 2, F.greatest(F.size(sorted_windows), F.lit(1)))
    places = F.flatten(F.filter(F.zip_with(sorted_windows, after, pair), lambda x: x.isNotNull()))
    words = F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))
    return F.size(F.array_distinct(words)).cast("long")


def measure(
    docs: DataFrame,
    common_words: dict[str, list[str]],
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """id, lang, the base counts, ``classes`` (counts per character class, the last for all
    others) and ``common`` (counts of the language's common words, the last for all others)."""
    listed = F.create_map(*[F.lit(x) for k, v in common_words.items() for x in (k, F.array(*map(F.lit, v)))])
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        text_words(F.col(text_col)).alias("words"),
    )
    lines = F.filter(F.split("text", "\n", -1), lambda s: F.regexp_like(s, F.lit(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "id",
        "lang",
        "words",
        lines.alias("lines"),
        _windows(F.col("words")).alias("windows"),
        _left(F.col("text"), SYMBOLS).alias("n_symbols"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.array(*[_left(F.col("text"), removed) for removed in CLASSES.values()]).alias("in_class"),
        F.get(F.map_values(F.map_filter(listed, lambda k, v: k == F.col("lang"))), 0).alias("listed"),
    )
    count = lambda w: F.size("words") - F.size(F.array_remove("words", w))
    rows = rows.select(
        "id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("windows")).alias("n_repeat_words"),
        "n_chars",
        "in_class",
        F.transform("listed", lambda w: count(w).cast("long")).alias("hits"),
    )
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    with_rest = lambda a, n: F.concat(a, F.array(F.col(n) - total(F.col(a))))
    return rows.select(
        "id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_chars",
        with_rest("in_class", "n_chars").alias("classes"),
        with_rest("hits", "n_words").alias("common"),
    )


def base_failed(min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))


def js_distance(counts: Column, n: Column, reference: Column, m: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two arrays of counts with the
    totals ``n`` and ``m``."""
    part = lambda x, mean: F.when(x > 0, x * F.log2(x / mean)).otherwise(0.0)
    term = lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2
    terms = F.zip_with(counts, reference, lambda x, y: term(x / n, y / m))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _summed(rows: DataFrame, column: str, n: int, alias: str) -> Column:
    return F.array(*[F.coalesce(F.sum(F.get(column, F.lit(i))), F.lit(0)) for i in range(n)]).alias(alias)


def quality(
    docs: DataFrame,
    common_words: dict[str, list[str]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """One row per document: id, the base counts, base_failed, kept, class_distance and
    word_distance (null where a guard leaves the document unjudged)."""
    common_words = common_words or COMMON_WORDS
    measured = kept(measure(docs, common_words, id_col, text_col, lang_col).withColumn("base_failed", base_failed()))
    n_classes, n_common = len(CLASSES) + 1, max(map(len, common_words.values())) + 1
    clean = measured.where(~F.col("base_failed"))
    sums = [_summed(clean, "classes", n_classes, "ref_classes"), _summed(clean, "common", n_common, "ref_common")]
    sums += [F.sum("n_chars").alias("ref_chars"), F.sum(F.when(F.col("common").isNotNull(), F.col("n_words"))).alias("ref_words")]
    # one row per language with a list, and one for all others: as few as the parameter has
    known = F.when(F.col("lang").isin(*common_words), F.col("lang")).otherwise(F.lit(""))
    per_lang = clean.groupBy(known.alias("key")).agg(*sums)
    everyone = clean.agg(*sums).select(F.lit("").alias("key"), "*")
    references = F.broadcast(per_lang.where("key <> ''").union(everyone))
    rows = measured.withColumn("key", known).join(references, "key", "left")
    rows = rows.withColumn("ref_common", F.slice("ref_common", 1, F.greatest(F.size("common"), F.lit(0))))
    judged = lambda n, guard, m, distance: F.when((F.col(n) >= guard) & (F.col(m) > 0), distance)
    by_class = judged("n_chars", GUARD_CHARS, "ref_chars", js_distance(F.col("classes"), F.col("n_chars"), F.col("ref_classes"), F.col("ref_chars")))
    by_word = judged("n_words", GUARD_WORDS, "ref_words", js_distance(F.col("common"), F.col("n_words"), F.col("ref_common"), F.col("ref_words")))
    rows = rows.withColumns({"class_distance": by_class, "word_distance": by_word})
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"),
        "class_distance",
        "word_distance",
    )
