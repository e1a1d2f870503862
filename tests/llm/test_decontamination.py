import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from panelscope.llm import decontamination
from panelscope.llm.decontamination import benchmark_words, decontaminate

from . import edge

ITEMS = "item_id long, text string"
SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, items, window=10):
    cut = []
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        cut += [(item, words[i : i + n]) for i in range(len(words) - n + 1)] if words else []
    out = []
    for doc_id, text in rows:
        words, hit, ids = words_of(text), set(), set()
        for item, passage in cut:
            for at in range(len(words) - len(passage) + 1):
                if words[at : at + len(passage)] == passage:
                    hit |= set(range(at, at + len(passage)))
                    ids |= {str(item)} if item is not None else set()
        listed = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(ids), listed, bool(hit)))
    return sorted(out, key=repr)


def planted():
    random.seed(6)
    vocabulary = [f"x{i}" for i in range(60)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randrange(8, 40)))) for i in range(30)]
    items += [(100, items[0][1]), (100, "other words of one id that are ten in number all told"), (101, items[1][1].upper() + "!"), (None, items[2][1])]
    items += [(102, "Two words"), (103, "one"), (104, None), (105, ""), (106, "..."), (107, "a a a a a a a a a a a a"), (108, "é \U0001f600 ß")]
    rows = [(r[0], r[1]) for r in edge.rows() if r[0] != 7]
    for i in range(200, 260):
        before, after = (" ".join(random.choices(vocabulary, k=random.randrange(30))) for _ in range(2))
        passage = words_of(random.choice(items)[1])
        at, to = sorted(random.choices(range(len(passage) + 1), k=2))
        rows.append((i, f"{before}, {'-'.join(passage[at:to])}; {after}"))
    rows += [(300, "a " * 25), (301, "Two\x00WORDS two words"), (302, "xone one"), (303, "É \U0001f600 ß é \U0001f600 ß")]
    rows += [rows[-1]] * 2 + [(None, items[3][1]), (304, items[0][1]), (305, " ".join(t or "" for _, t in items))]
    return rows, items


@pytest.mark.parametrize("small", [True, False])
def test_matches_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    rows, items = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, ITEMS)
    want = plain(rows, items)
    assert sum(r[5] for r in want) > 25
    assert edge.listed(decontaminate(docs, bench)) == want
    more = bench.select("*", F.lit(1).alias("words"), F.lit(2).alias("id"), F.lit(3).alias("class"))
    assert edge.listed(decontaminate(edge.clashing(docs), more)) == want
    assert edge.listed(decontaminate(docs, bench, window=7)) == plain(rows, items, 7)


def test_empty_tables_and_long_texts(spark):
    bench = spark.createDataFrame([(1, edge.LONG[-200:]), (2, "w5 the of")], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate(edge.empty(spark), bench).count() == 0
    docs = edge.docs(spark)
    rows = [(r[0], r[1]) for r in edge.rows()]
    assert edge.listed(decontaminate(docs, none)) == plain(rows, [])
    long = decontaminate(docs.where("doc_id = 7"), bench).first()
    n = len(words_of(edge.LONG))
    assert (long["n_words"], long["n_items"]) == (n, 2) and 0 < long["n_hit"] < n


def test_a_whole_document_of_hits(spark):
    docs = spark.createDataFrame([(7, edge.LONG)], "doc_id long, text string")
    got = decontaminate(docs, spark.createDataFrame([(1, edge.LONG)], ITEMS)).first()
    assert got["n_hit"] == got["n_words"] == len(words_of(edge.LONG))


def test_copies_make_no_pairs(spark):
    """Many copies of a document and of an item: one class of items, a row per document and window."""
    passage = " ".join(f"p{i}" for i in range(15))
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(passage).alias("text"))
    items = spark.range(400).select(F.col("id").alias("item_id"), F.lit(passage).alias("text"))
    classes = decontamination.item_classes(items).cache()
    windows = decontamination.item_windows(classes, 10).cache()
    assert (classes.count(), windows.count()) == (1, 6)
    assert decontamination.occurrences(docs, windows).where("wid IS NOT NULL").count() == 500 * 6
    got = decontaminate(docs, items).agg(F.min("n_items"), F.max("n_items"), F.countDistinct("items_sha256"), F.sum("n_hit")).first()
    assert tuple(got) == (400, 400, 1, 500 * 15)


def test_words(spark):
    texts = ["A-b C", "", None, " x ", "\x00q\x7fR", "Ünï{code}", "a b", "123 4"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(benchmark_words(F.col("t")))
    assert [list(r[0]) for r in df.collect()] == [words_of(t) for t in texts]


def test_runs_without_python(spark):
    got = decontaminate(edge.docs(spark), spark.createDataFrame([(1, edge.EN)], ITEMS))
    assert "Python" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
