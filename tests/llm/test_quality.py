import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelscope.llm import divergence
from panelscope.llm.divergence import js_distance, quality

from . import edge


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {p for i, w in enumerate(windows) if n[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


TEXTS = [
    "a b c a b c", "a b c d a b", "a a a a", "x\n\nx\n x\nx\r\ny", "#$%& | <> ***", "one\x0btwo\x1cthree", "é ß \U0001f600 é ß \U0001f600",
    "n " * 200, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 40}" for i in range(200)),
]


def test_base_counts_match_brute_force(spark):
    rows = [(100 + i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + edge.rows()
    df = spark.createDataFrame(rows, edge.DOCS)
    want = sorted(((r[0], *base(r[1])) for r in rows), key=repr)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert edge.listed(quality(df).select(columns)) == want
    assert edge.listed(quality(edge.clashing(df))) == edge.listed(quality(df))
    assert quality(edge.empty(spark)).count() == 0


def test_unlike_documents_are_not_kept(spark):
    prose = [(i, " ".join(f"the w{i}x{j} of y{j} and z{j}" for j in range(30)), "en", "s", 0) for i in range(40)]
    marks = (90, " ".join(f"&&&w{j}### $$$v{j}%%%" for j in range(60)), "en", "s", 0)
    no_words = (91, " ".join(f"qz{j} vv{j}" for j in range(100)), "en", "s", 0)
    got = {r["doc_id"]: r for r in quality(spark.createDataFrame([*prose, marks, no_words], edge.DOCS)).collect()}
    assert not got[90]["kept"] and not got[91]["kept"] and all(got[i]["kept"] for i in range(40))
    assert got[90]["class_distance"] > divergence.MAX_CLASS_DISTANCE and got[91]["word_distance"] > divergence.MAX_WORD_DISTANCE
    assert not any(r["base_failed"] for r in got.values())


@pytest.mark.parametrize("p,q", [([1, 0, 3], [2, 2, 0]), ([5, 5], [5, 5]), ([1, 0], [0, 1])])
def test_distance(spark, p, q):
    def kl(a, b):
        return sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)

    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(x + y) / 2 for x, y in zip(a, b, strict=True)]
    col = js_distance(F.array(*map(F.lit, p)), F.lit(sum(p)), F.array(*map(F.lit, q)), F.lit(sum(q)))
    assert spark.range(1).select(col).first()[0] == pytest.approx(math.sqrt((kl(a, m) + kl(b, m)) / 2))


def test_runs_without_python(spark):
    plan = quality(edge.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
