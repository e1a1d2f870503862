"""URL filters: a blocked Bloom filter of the listed canonical URLs passes possible hits to
an exact hash join that removes its false positives.

A rule is (verdict, host + path), e.g. ``("block", "example.com/de/")``. It fits its host and
every subdomain, if the url's path starts with the rule's path; of the rules that fit, the
longest (then the one with the longer host) decides. A url that no rule fits gets the default.

Each distinct (host, path) is expanded to the keys that could be listed: its host suffixes of as
many labels as occur in the list x its path prefixes of the lengths that do. Every key belongs to
one 256-bit block of the filter and sets one bit in each of the block's four words. The
filter's blocks and the rules are broadcast only when their counted size is small; else both
joins are shuffles. DataFrame functions only.

Edge cases: a null url, or one without ``://``, has an empty host and path and gets the
default; repeated rows are judged each; no rules: every url gets the default; no pages: no rows;
rules that are null or have no ``/`` raise an error; of a rule listed with several verdicts the last
in alphabetical order holds (block, not allow); very long hosts and paths are compared whole, at the
listed lengths only; the rows' other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.common import BROADCAST_BYTES, LOWER, UPPER

BITS_PER_KEY = 16
BLOCK_BITS = 256
WORDS_PER_BLOCK = 4

Rules = Sequence[tuple[str, str]]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``)."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.char_length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = rest.substr(F.char_length(host) + 1, F.greatest(F.char_length(rest), F.lit(1)))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(tail, r"^[^?#]*", 0)


def rule_table(spark: SparkSession, rules: Rules | DataFrame) -> DataFrame:
    """Columns rule, rule_host, rule_path, rule_verdict from (verdict, rule) pairs, or from a
    DataFrame of any size with the columns verdict and rule."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule string")
    valid = F.col("rule").contains("/") & F.col("verdict").isNotNull()
    rule = F.when(valid, F.col("rule")).otherwise(F.raise_error(F.lit("a rule is a verdict and host/path")))
    return rules.select(
        rule.alias("rule"),
        F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER).alias("rule_host"),
        F.expr("substr(rule, instr(rule, '/'))").alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    )


def bloom_keys(host: Column, path: Column, n_blocks: int) -> list[Column]:
    """The block of a key and its one bit in each of the block's words."""
    first, second = F.xxhash64(host, F.lit("/"), path), F.xxhash64(path, F.lit("|"), host)
    bits = [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(63).cast("int"))
        for i in range(WORDS_PER_BLOCK)
    ]
    return [F.pmod(first, F.lit(n_blocks)).alias("block"), *[b.alias(f"bit{i}") for i, b in enumerate(bits)]]


def blocked_bloom(rules: DataFrame, n_blocks: int) -> DataFrame:
    """One row per non-empty block: block, word0 .. word3."""
    keys = rules.select(*bloom_keys(F.col("rule_host"), F.col("rule_path"), n_blocks))
    return (
        keys.groupBy("block")
        .agg(*[F.bit_or(f"bit{i}").alias(f"word{i}") for i in range(WORDS_PER_BLOCK)])
        .withColumnRenamed("block", "filter_block")
    )


def listed_keys(urls: DataFrame, lengths: list[int], depths: list[int]) -> DataFrame:
    """(host, path, key_host, key_path): the keys under which a url could be listed, host suffixes
    of as many labels as listed hosts have (``depths``) with path prefixes of listed lengths."""
    labels = F.split("host", r"\.")
    known = F.filter(F.array(*[F.lit(n) for n in depths]), lambda n: n <= F.size(labels))
    suffixes = F.transform(known, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("path"))
    prefixes = F.transform(sizes, lambda n: F.col("path").substr(F.lit(1), n))
    parts = urls.select("host", "path", suffixes.alias("suffixes"), prefixes.alias("prefixes"))
    return parts.select("host", "path", F.explode("suffixes").alias("key_host"), "prefixes").select(
        "host", "path", "key_host", F.explode("prefixes").alias("key_path")
    )


def url_filter(
    pages: DataFrame, rules: Rules | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per row of ``pages``: the id, host, path, rule (null: none fits), verdict."""
    spark = pages.sparkSession
    listed = rule_table(spark, rules).groupBy("rule_host", "rule_path").agg(F.min("rule").alias("rule"), F.max("rule_verdict").alias("rule_verdict"))
    # as many as there are path lengths and numbers of labels, not rules
    lengths, labels = F.collect_set(F.char_length("rule_path")), F.collect_set(F.size(F.split("rule_host", r"\.")))
    n, chars, sizes, depths = listed.agg(F.count("*"), F.sum(F.char_length("rule")), lengths, labels).first()
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    if not n:
        return urls.select(
            F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )

    n_blocks = max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))
    bloom = blocked_bloom(listed, n_blocks)
    small = F.broadcast if max(n_blocks * 40, 4 * (chars or 0) + 64 * n) <= BROADCAST_BYTES else (lambda side: side)
    keys = listed_keys(urls.where(F.col("host") != "").select("host", "path").distinct(), sorted(sizes), sorted(depths))
    probe = keys.select("*", *bloom_keys(F.col("key_host"), F.col("key_path"), n_blocks))
    possible = F.col("block") == F.col("filter_block")
    for i in range(WORDS_PER_BLOCK):
        possible = possible & (F.col(f"word{i}").bitwiseAND(F.col(f"bit{i}")) == F.col(f"bit{i}"))
    passed = probe.join(small(bloom), possible).select("host", "path", "key_host", "key_path")
    exact = (F.col("key_host") == F.col("rule_host")) & (F.col("key_path") == F.col("rule_path"))
    longest = F.struct(F.char_length("rule"), F.char_length("rule_host"), "rule")
    decided = (
        passed.join(small(listed), exact)
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "rule_verdict"), longest).alias("best"))
        .select(F.col("host").alias("h"), F.col("path").alias("p"), "best")
    )
    return urls.join(decided, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
