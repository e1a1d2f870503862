import os

import pytest

from panelscope.llm.pieces import MODEL, Pieces, decode, nbest_encode, read_model

from . import edge

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def pieces():
    return Pieces(read_model())


def all_paths(pieces, text):
    """Every path's score, by trying all segmentations."""
    scores = []

    def go(at, score):
        if at == len(text):
            scores.append(score)
            return
        single = False
        for end in range(at + 1, len(text) + 1):
            i = pieces.id_of.get(text[at:end])
            if i is not None:
                single = single or end == at + 1
                go(end, score + pieces.score[i])
        if not single:
            go(at + 1, score + pieces.unknown_score)

    go(0, 0.0)
    return sorted(scores, reverse=True)


@pytest.mark.parametrize("text", ["a", "hello", "the thion", "x,y", "né. de", "is is is", "ab\ncd", "a  b", "\u4e2d\u6587", "\U0001f600a"])
def test_scores_match_all_segmentations(pieces, text):
    want = all_paths(pieces, pieces.normalise(text))
    for n in (1, 2, 5, 30):
        got = pieces.nbest(text, n)
        assert [s for s, _ in got] == want[:n]
        assert len({tuple(i.tolist()) for _, i in got}) == len(got)
        assert all(pieces.decode(i) == text for _, i in got)


def test_matches_the_library_when_the_scores_are_a_unigram_model(pieces):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    proto = pb.ModelProto()
    proto.ParseFromString(read_model())
    proto.trainer_spec.model_type = 1
    unigram = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in ["Hello world", "The thionst of the and. Nt it anoust", "Éen dans ench le de aianè"]:
        assert [i.tolist() for _, i in pieces.nbest(text, 4)] == unigram.nbest_encode_as_ids(text, 4)


def test_ties_are_ordered_by_ids_from_the_end(pieces):
    for text in ("aaaa", "ththth", "ererer"):
        paths = pieces.search(pieces.normalise(text), 50)
        keys = [(-s, p[::-1]) for s, p in paths]
        assert keys == sorted(keys)


def test_edges(spark):
    df = edge.clashing(edge.docs(spark))
    rows = nbest_encode(df, n=2).collect()
    assert all(r["round_trip"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [(r["rank"], r["score"], r["ids"]) for r in by[4]] == [(1, 0.0, [])] == [(r["rank"], r["score"], r["ids"]) for r in by[5]]
    assert len(by[9]) == 4 and len(by[7]) == 2 and by[7][0]["score"] >= by[7][1]["score"]
    assert nbest_encode(edge.empty(spark)).count() == 0


def test_decoding_gives_the_texts_back(spark):
    df = edge.docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    back = nbest_encode(df, n=1).withColumn("back", decode("ids"))
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    assert {r["doc_id"]: r["back"] for r in back.collect()} == texts


def test_the_memory_of_segments_is_bounded(pieces, monkeypatch):
    monkeypatch.setattr("panelscope.llm.pieces.REMEMBERED", 10)
    small = Pieces(read_model())
    texts = [f"word{i} the thion{i}" for i in range(40)] + [" ".join(f"word{i} the" for i in range(200))]
    for text in texts:
        best = small.nbest(text, 3)
        assert len(small.learned.rows) <= 10 + len(set(small.split(text)))
        assert [(s, i.tolist()) for s, i in best] == [(s, i.tolist()) for s, i in pieces.nbest(text, 3)]
