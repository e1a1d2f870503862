import os

import pytest

import corpus_pipeline
from panelscope.llm.langid import fit, identify
from panelscope.llm.pieces import MODEL, Pieces, read_model
from panelscope.llm.secret_scan import redacted, spans_of

from . import edge
from .test_language import corpus
from .test_simhash import plain_components

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")


def test_stages_match_brute_force(spark, tmp_path):
    rows = corpus(150, 9) + [(i + 500, t + (" token = abc123def456" if i % 9 == 0 else ""), lang, s, n) for i, t, lang, s, n in corpus(60, 9)]
    rows += [(900, None, "en", "a", 0), (901, "!!", "en", None, 2), (902, rows[0][1], "en", "a", 0)]
    docs = edge.clashing(spark.createDataFrame(rows, edge.DOCS))
    stages = dict(corpus_pipeline.STAGES)
    assert 4 <= len(stages) <= 5

    one = stages["language"](spark, docs, "")
    rejected = {r["doc_id"] for r in identify(docs, fit(docs)).collect() if r["rejected"]}
    left = {r["doc_id"]: r for r in one.collect()}
    assert {900, 901} <= rejected and left.keys() == {r[0] for r in rows} - rejected

    two = stages["near_duplicates"](spark, one, "")
    groups = {c for _, _, c in plain_components([(i, r["text"]) for i, r in left.items()])}
    left = {r["doc_id"]: r for r in two.collect()}
    assert left.keys() == groups and 902 not in left

    three = stages["secrets"](spark, two, "")
    texts = {r["doc_id"]: r["text"] for r in three.collect()}
    assert texts == {i: redacted(r["text"], spans_of(r["text"])[1]) for i, r in left.items()}
    assert not any("abc123def456" in t for t in texts.values())

    four = stages["mix"](spark, three, "")
    mixed = four.collect()
    assert {r["doc_id"] for r in mixed} <= texts.keys() and all(texts[r["doc_id"]] == r["text"] for r in mixed)
    words = sum(len(t.split()) for t in texts.values())
    assert abs(sum(len(r["text"].split()) for r in mixed) - 1.5 * words) <= 110
    assert one.columns == two.columns == three.columns == four.columns == docs.columns

    five = stages["pieces"](spark, four, "").collect()
    pieces = Pieces(read_model())
    want = sorted((r["doc_id"], k + 1, s, i.tolist()) for r in mixed for k, (s, i) in enumerate(pieces.nbest(r["text"], 3)))
    assert sorted((r["doc_id"], r["rank"], r["score"], r["ids"]) for r in five) == want


def test_run_reads_the_documents_table(spark, tmp_path):
    edge.docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "ids" in out.columns


def test_empty_table(spark, tmp_path):
    edge.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
