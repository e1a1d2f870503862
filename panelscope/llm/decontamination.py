"""Benchmark passages in documents, by a prefix-filtered join of word shingles.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window). Its
record is the set of its shingles of SHINGLE words with their places. A document window holds it
whole (containment 1), so of a record's r shingles r - ceil(1 * r) + 1 = 1 is a necessary prefix:
every occurrence has the rarest one. The join goes by that token:

1. rarity: the documents' shingles that any record has are counted over all documents;
2. each window's shingles are put in order (count, then hash, then place), the first is its prefix;
3. every shingle of every document meets the prefixes; a meeting fixes where the window would start
   in the document, which must lie within it (positional and length bound), and the document's
   window of the item window's size is compared word by word (exact containment).

Words are taken as in ``benchmark_words``. Both scans are narrow where the windows' counted size is
below BROADCAST_BYTES; beyond it they shuffle the shingles, each with the few words around it, never
a document. Items of equal words are one class, whose ids are listed once; windows of equal words
are one record; a document's matched windows and classes are made distinct before anything is
attached to them, so neither a large group of copies of a document nor one of an item makes
pairs. Everything here is native: no Python on rows.

Edge cases: a null or empty text has no words, neither hits nor is hit; an item without an id
marks the words it hits, but is not counted or listed; equal ids of several items are one item;
repeated rows of documents come back as often, with equal results; very long texts are taken
whole (a document's words are one array, a match carries a window's words only); rarity ties are
broken by hash and place, and don't change results; further columns are not read; no items: every
document is clean; no documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelscope.llm.common import BROADCAST_BYTES, LOWER, UPPER, kept

WINDOW = 10
SHINGLE = 5  # words; a window of fewer is one shingle
BASE_KEYS = 64  # keys by which the documents' own rows pass the join
ROW_BYTES = 96  # of a window's record beside its words
# What stands between words, after A-Z were lowered.
BETWEEN = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def benchmark_words(text: Column) -> Column:
    """Array of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of ``text`` with A-Z lowered (null: none)."""
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN)))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def _hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def _token(words: Column, at: Column, k: Column, sizes: list[int]) -> Column:
    out = F.lit(None).cast("long")
    for size in sizes:
        out = F.when(k == size, _hash(words, at, size)).otherwise(out)
    return out


def item_classes(items: DataFrame) -> DataFrame:
    """Items of equal words: class, words, ids (their distinct ids as strings)."""
    read = items.select(F.col("item_id").cast("string").alias("id"), benchmark_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    return read.groupBy("words").agg(F.collect_set("id").alias("ids")).select(F.monotonically_increasing_id().alias("class"), "words", "ids")


def item_windows(classes: DataFrame, window: int) -> DataFrame:
    """Distinct windows: wid, words, size, k (their shingles' words), classes."""
    size = F.least(F.lit(window), F.size("words"))
    starts = classes.select("class", "words", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("at"))
    cut = starts.select("class", F.slice("words", F.col("at") + 1, F.col("size")).alias("words"))
    distinct = cut.groupBy("words").agg(F.collect_set("class").alias("classes"))
    return distinct.select(
        F.monotonically_increasing_id().alias("wid"), "words", F.size("words").alias("size"), F.least(F.lit(SHINGLE), F.size("words")).alias("k"), "classes"
    )


def _shingled(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, digest, words, n and one row per shingle (at, k, token), with one more row per
    document (at -1, k 0). Position i of the exploded range stands for shingle size i % sizes."""
    m = max(1, len(sizes))
    read = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), benchmark_words(F.col("text")).alias("words"))
    counted = read.select("*", F.size("words").alias("n"))
    last = F.col("n") * m - 1 if sizes else F.lit(-1)
    places = counted.select("*", F.explode(F.sequence(F.lit(-1), last)).alias("i"))
    k = F.lit(sizes[0]) if len(sizes) == 1 else F.element_at(F.array(*map(F.lit, sizes or [0])), F.col("i") % m + 1)
    base = F.col("i") < 0
    placed = places.select(
        "doc_id", "digest", "words", "n", F.when(base, -1).otherwise(F.floor(F.col("i") / m)).cast("int").alias("at"), F.when(base, 0).otherwise(k).alias("k")
    ).where((F.col("at") < 0) | (F.col("at") + F.col("k") <= F.col("n")))
    own = F.xxhash64(F.lit(0), F.pmod(F.xxhash64("doc_id", "digest"), F.lit(BASE_KEYS)))
    return placed.withColumn("token", F.when(F.col("at") < 0, own).otherwise(_token(F.col("words"), F.col("at"), F.col("k"), sizes)))


def rarest_tokens(docs: DataFrame, windows: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """windows with the token of their rarest shingle and its ``place`` in the window."""
    at = F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))).alias("place")
    tokens = windows.select("wid", "words", "k", at).select("wid", "place", _token(F.col("words"), F.col("place"), F.col("k"), sizes).alias("token"))
    known = tokens.select("token").distinct()
    shingles = _shingled(docs, sizes).where("at >= 0").select("token")
    counts = shingles.join(F.broadcast(known) if small else known, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
    ordered = tokens.join(counts, "token", "left").select("wid", F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "token", "place").alias("x"))
    first = ordered.groupBy("wid").agg(F.min("x").alias("x")).select("wid", "x.token", "x.place")
    return windows.join(first, "wid")


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Where windows occur: doc_id, digest (of the text), n, start (in words), size, wid; and one
    row per row of ``docs`` with a null wid."""
    sizes = sorted(r[0] for r in windows.select("k").distinct().collect())  # at most SHINGLE numbers
    words_bytes = F.sum(F.length(F.concat_ws(" ", "words")) + 16 * F.col("size") + ROW_BYTES)
    small = (windows.agg(words_bytes).first()[0] or 0) * SHINGLE <= BROADCAST_BYTES
    prefixes = kept(rarest_tokens(docs, windows, sizes, small).select("token", "place", "size", "wid", F.col("words").alias("window")))
    spark = docs.sparkSession
    own = spark.range(BASE_KEYS).select(F.xxhash64(F.lit(0), F.col("id")).alias("token"))
    records = prefixes.unionByName(own, allowMissingColumns=True)
    shingles = _shingled(docs, sizes)
    if small:
        records, around, skipped = F.broadcast(records), F.col("words"), F.lit(0)
    else:  # the words around a shingle, enough for any window that holds it
        reach = windows.agg(F.max("size")).first()[0]
        first = F.greatest(F.col("at") - reach, F.lit(0))
        shingles = shingles.select("doc_id", "digest", "n", "at", "token", F.slice("words", first + 1, F.lit(2 * reach + SHINGLE)).alias("words"), first.alias("first"))
        around, skipped = F.col("words"), F.col("first")
    start = F.col("at") - F.col("place")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n"))
    equal = F.slice(around, F.greatest(start - skipped, F.lit(0)) + 1, F.col("size")) == F.col("window")
    met = shingles.join(records, "token").where(F.when(F.col("at") < 0, F.col("wid").isNull()).otherwise(F.col("wid").isNotNull() & inside & equal))
    return met.select("doc_id", "digest", F.col("n").cast("long").alias("n"), start.alias("start"), "size", "wid")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    classes = kept(item_classes(items))
    windows = kept(item_windows(classes, window))
    found = kept(occurrences(docs, windows))
    key = ["doc_id", "digest"]
    documents = found.where("wid IS NULL").groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n_words"))
    spans = found.where("wid IS NOT NULL").select(*key, "start", "size", "wid").distinct()
    # A document's spans: those of one start end where the longest does; then what each adds to those before.
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = spans.groupBy(*key, "start").agg((F.col("start") + F.max("size")).alias("end"))
    added = ends.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = added.groupBy(*key).agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "done"), F.lit(0))).cast("long").alias("n_hit"))
    of_class = spans.select(*key, "wid").distinct().join(windows.select("wid", F.explode("classes").alias("class")), "wid").select(*key, "class").distinct()
    ids = of_class.join(classes.select("class", "ids"), "class").groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    matched = hits.withColumnsRenamed({"doc_id": "d", "digest": "g"}).join(
        ids, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("digest"))
    ).select("d", "g", "n_hit", "ids")
    all_rows = documents.join(matched, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    listed = F.coalesce("ids", F.array().cast("array<string>"))
    return all_rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"),
    ).drop("copy")
