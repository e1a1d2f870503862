import random
import zlib

import numpy as np

from panelscope.llm import langid

from . import edge

SYLLABLES = {
    "en": "th the ing er an re on at en nd ti es or te of ed is it al ar st to nt".split(),
    "de": "en er ch sch ei un die te ge ich be ung lich keit zu ü ä ö ß".split(),
    "fr": "le es on ent de re ou que ai an er eau eux tion é è ç".split(),
}


def corpus(n, seed):
    random.seed(seed)
    out = []
    for i in range(n):
        lang = random.choice(list(SYLLABLES))
        words = ["".join(random.choices(SYLLABLES[lang], k=random.randint(1, 4))) for _ in range(random.choice([4, 20, 100]))]
        out.append((i, " ".join(words), lang if i % 11 else None, "s", 0))
    return out


def test_held_out_accuracy_and_score(spark):
    rows = corpus(1200, 1)
    df = spark.createDataFrame(rows, edge.DOCS)
    got = langid.identify(df, langid.fit(df)).collect()
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(held) > 200 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got) and np.mean([r["rejected"] for r in got]) < 0.02


def test_prediction_does_not_see_label_source_or_id(spark):
    rows = corpus(300, 2)
    df = spark.createDataFrame(rows, edge.DOCS)
    model = langid.fit(df)
    other = spark.createDataFrame([(i, t, "xx", "other", 9) for i, t, *_ in rows], edge.DOCS)
    assert edge.listed(langid.identify(df, model)) == edge.listed(langid.identify(other, model))


def test_held_out_documents_are_not_learned_from(spark):
    rows = corpus(300, 3)
    poisoned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in rows]
    a, b = (langid.fit(spark.createDataFrame(r, edge.DOCS)) for r in (rows, poisoned))
    assert a.labels == b.labels == ["de", "en", "fr"] and np.array_equal(a.logits, b.logits)


def test_edges(spark):
    df = edge.docs(spark)
    model = langid.fit(df)
    found = {r["doc_id"]: r for r in langid.identify(edge.clashing(df), model).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (4, 5, 6, 11))
    assert found[7]["lang_pred"] in model.labels and found[None]["held_out"] is False
    kept = langid.drop_rejected(edge.clashing(df), model)
    assert kept.columns == edge.clashing(df).columns and {4, 5, 6, 11}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert langid.fit(edge.empty(spark)) is None and langid.identify(edge.empty(spark), None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}


def brute_subwords(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return sum(len(w) + sum(max(0, len(w) + 2 - n + 1) for n in (2, 3, 4)) for w in words)


def test_subword_counts_match_the_definition():
    texts = ["", "a", "Ab, c", "  é中 x", "!!", "\0a\0", edge.EN, "z"]
    ids, counts = langid.subwords(texts)
    assert counts.tolist() == [brute_subwords(t) for t in texts] and len(ids) == counts.sum()
    alone = [langid.subwords([t])[0] for t in texts]
    assert np.array_equal(np.sort(np.concatenate(alone)), np.sort(ids))
    starts = np.cumsum(counts) - counts
    for a, s, c in zip(alone, starts, counts, strict=True):
        assert np.array_equal(np.sort(a), np.sort(ids[s : s + c]))


def plain_scores(model, text):
    """The softmax of the mean logits, subword by subword: n-grams of a bordered word without crossing its ends."""
    total, n = np.zeros(len(model.labels)), 0
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        codes = [0, *map(ord, word), 0]
        for size in langid.ORDERS:
            for at in range(len(codes) - size + 1):
                gram = codes[at : at + size]
                if size == 1 and gram == [0]:
                    continue
                h = 0
                for c in gram:
                    h = (h * 0x100000001B3 + c) % 2**64
                bucket = ((h + size) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - langid.BUCKETS.bit_length() + 1)
                total, n = total + model.logits[bucket], n + 1
    z = total / n + model.bias
    e = np.exp(z - z.max())
    return e / e.sum()


def test_scores_match_a_plain_recomputation(monkeypatch):
    rows = [r for r in corpus(400, 6) if r[2]]
    model = langid.train([r[1] for r in rows], [r[2] for r in rows], [i % 5 == 0 for i in range(len(rows))])
    texts = [r[1] for r in rows[:25]] + ["é", "a1b", "Straße, STRASSE!", edge.EN + edge.DE, "x" * 700 + "1" + "th" * 50]
    for limit in (1 << 17, 100, 7):  # parts and batches of any size give the same
        monkeypatch.setattr(langid, "TEXT_PART", limit)
        monkeypatch.setattr(langid, "BATCH_CHARS", limit)
        labels, scores, _ = langid.judged(model, texts)
        for text, label, score in zip(texts, labels, scores, strict=True):
            want = plain_scores(model, text)
            assert label == model.labels[int(want.argmax())] and abs(score - want.max()) < 1e-5


def test_fewer_and_shorter_pieces_are_parameters(spark):
    df = spark.createDataFrame(corpus(200, 7), edge.DOCS)
    few, many = langid.fit(df, fragments=1, piece=20), langid.fit(df, fragments=8, piece=400)
    assert few.labels == many.labels == ["de", "en", "fr"] and not np.array_equal(few.logits, many.logits)


def test_long_texts_are_read_whole(spark, monkeypatch):
    model = langid.train([edge.EN, edge.DE] * 20, ["en", "de"] * 20, [False] * 30 + [True] * 10)
    monkeypatch.setattr(langid, "TEXT_PART", 100)
    assert langid.predict(model, [edge.EN + edge.DE * 9])[0] == ["de"]
    assert "".join(langid._parts("ab cd " * 99)) == "ab cd " * 99 and "".join(langid._parts("x" * 999)) == "x" * 999
    assert max(map(len, langid._parts("ab1cd2" * 99))) <= 100 and list(langid._parts("x" * 999 + "1y" * 60))[0] == "x" * 999


def test_unlearned_languages_are_rejected_and_mixtures_stay(spark):
    rows = [r for r in corpus(1500, 4) if len(r[1]) > 60]
    for learned in (["de", "en", "fr"], ["de", "en"], ["fr"]):
        df = spark.createDataFrame([r for r in rows if r[2] in learned], edge.DOCS)
        model = langid.fit(df)
        at = {l: [r[1] for r in rows if r[2] == l] for l in SYLLABLES}
        for lang, texts in at.items():
            rejected = np.mean(langid.judged(model, texts)[2])
            assert rejected <= 0.02 if lang in learned else rejected >= 0.9
        both = [f"{a} {b}" for a, b in zip(at[learned[0]], at[learned[-1]], strict=False)]
        assert np.mean(langid.judged(model, both)[2]) <= 0.02
        random.seed(5)
        noise = ["".join(random.choices("bcdfghjklmnpqrstvwxz    ", k=200)) for _ in range(50)]
        assert np.mean(langid.judged(model, noise)[2]) == 1.0
