import random

import pytest

from panelscope.llm.license_scan import TEMPLATES, plain_words, scan_licenses

from . import edge


def found(df, **options):
    return {(r["doc_id"], r["license"]): r for r in scan_licenses(df, **options).collect()}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], edge.DOCS)


def filler(n, seed):
    random.seed(seed)
    return " ".join(random.choice(["thion", "of", "and", "ering", "st"]) + str(random.randrange(9)) for _ in range(n))


def test_every_template_is_found_in_any_text_and_nothing_else(spark):
    texts = [f"{filler(k + 31, k)} {text.upper() if k % 2 else text} {filler(17, 99 + k)}" for k, (_, text) in enumerate(TEMPLATES)]
    got = found(frame(spark, [*texts, filler(300, 7)]))
    for k, (name, _) in enumerate(TEMPLATES):
        assert got[k, name]["containment"] == 1.0
        assert got[k, name]["first_word"] == k + 31
    others = {k for k in got if TEMPLATES[k[0]][0] != k[1]} if len(got) else set()
    assert others <= {(k, n) for k, (_, t) in enumerate(TEMPLATES) for n, u in TEMPLATES if u.rstrip(".") in t}


@pytest.mark.parametrize("changed", [2, 4])
def test_near_copies_are_found_by_exact_containment(spark, changed):
    name, text = next(t for t in TEMPLATES if t[0] == "MIT")
    words = text.split()
    near = list(words)
    random.seed(changed)
    for at in random.sample(range(len(near)), changed):
        near[at] = "changed"
    df = frame(spark, [" ".join(near), " ".join(words[:70]), " ".join(words[::2])])
    plain = [r["w"] for r in frame(spark, [" ".join(near), text]).select(plain_words("text").alias("w")).collect()]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in plain]
    share = len(shingles[0] & shingles[1]) / len(shingles[1])
    got = found(df, templates=[(name, text)])
    assert share >= 0.8 and got.keys() == {(0, name)} and got[0, name]["containment"] == pytest.approx(share)


def test_repeated_notices_count_their_places(spark):
    got = found(frame(spark, ["Released under the MIT License. x y z " * 3]))
    assert got[0, "MIT-notice"]["n_places"] == 3


def test_edges(spark):
    short = [("two", "Public domain"), ("none", "..."), ("null", None)]
    got = found(frame(spark, ["public domain", None, "", "public"]), templates=short)
    assert got.keys() == {(0, "two")}
    df = edge.docs(spark)
    assert edge.listed(scan_licenses(edge.clashing(df))) == edge.listed(scan_licenses(df)) == []
    assert scan_licenses(edge.empty(spark)).count() == 0
    both = spark.createDataFrame([(None, "Released under the MIT License")] * 2, "doc_id long, text string")
    assert scan_licenses(both).count() == 2


def test_runs_without_python(spark):
    plan = scan_licenses(edge.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_siblings_are_told_apart_and_whole_texts_are_asked_for(spark):
    texts = dict(TEMPLATES)
    heads = ["GPL-2.0-header", "GPL-3.0-header", "LGPL-2.1-header", "LGPL-3.0-header", "AGPL-3.0-header"]
    names = [*heads, "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "LGPL-2.1"]
    parts = [texts["BSD-2-Clause"].split(" THIS SOFTWARE")[0], texts["ISC"].split(" THE SOFTWARE")[0], texts["Unlicense"].split(" In jurisdictions")[0]]
    both = f"{texts['GPL-2.0-header']} {filler(60, 3)} {texts['AGPL-3.0-header']}"
    got = found(frame(spark, [*(f"{filler(20, k)} {texts[n]}" for k, n in enumerate(names)), both, *parts]))
    want = {(k, n) for k, n in enumerate(names)} | {(len(names), "GPL-2.0-header"), (len(names), "AGPL-3.0-header")}
    assert got.keys() == want and all(r["containment"] == 1.0 and r["n_places"] == 1 for r in got.values())


@pytest.mark.parametrize("limit", ["BROADCAST_BYTES", "MAX_LISTED"])
def test_every_way_of_joining_gives_the_same(spark, monkeypatch, limit):
    texts = [f"{filler(k, k)} {text} {filler(9, k)}" for k, (_, text) in enumerate(TEMPLATES) if len(text) < 2000]
    df = frame(spark, [*texts, filler(200, 1), "", texts[0] + texts[1]])
    want = edge.listed(scan_licenses(df))
    monkeypatch.setattr(f"panelscope.llm.license_scan.{limit}", 0)
    assert len(want) > len(texts) - 5 and edge.listed(scan_licenses(df)) == want


def exact_scan(words, templates):
    """license -> (common shingles, containment) of the best place, every place of every template tried."""
    shingles = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    out = {}
    for name, own in templates.items():
        at = [i for i, x in enumerate(shingles) if x in own]
        length = len(own) + 2 * -(-len(own) // 5)
        for i in at:
            common = len({shingles[j] for j in range(i, min(i + length, len(shingles))) if shingles[j] in own})
            if common >= 0.8 * len(own) and common > out.get(name, (0, 0))[0]:
                out[name] = (common, common / len(own))
    return out


def test_recall_against_an_exact_scan_of_a_whole_table(spark):
    """All documents of the given table, with near copies of templates planted in a tenth of them."""
    random.seed(3)
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for k in range(0, len(rows), 10):
        words = random.choice(TEMPLATES[:14])[1].split()
        for at in random.sample(range(len(words)), len(words) // 60):
            words[at] = "altered"
        rows[k] = (rows[k][0], f"{rows[k][1]} {' '.join(words)} {rows[k][1][:300]}")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    split = {r["doc_id"]: r["w"] for r in df.select("doc_id", plain_words("text").alias("w")).collect()}
    plain = frame(spark, [t for _, t in TEMPLATES]).select("doc_id", plain_words("text").alias("w")).collect()
    templates = {TEMPLATES[r["doc_id"]][0]: {tuple(r["w"][i : i + 5]) for i in range(len(r["w"]) - 4)} for r in plain if len(r["w"]) > 4}
    got = found(df)
    exact = {doc_id: exact_scan(words, templates) for doc_id, words in split.items()}
    want = {(doc_id, max(places, key=lambda n: (places[n], n))) for doc_id, places in exact.items() if places}
    assert len(want) > 20 and len(want & got.keys()) >= 0.95 * len(want), want - got.keys()
    assert all(name in exact[doc_id] for doc_id, name in got if name in templates)
