import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelscope.llm.components import components
from panelscope.llm.simhash import drop_near_duplicates, fingerprint, simhash_components, trie_pairs

from . import edge


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((rows[i][0], f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def test_fingerprint_matches_the_definition():
    for text in [None, "", "One", "one two", "One two THREE", "Äpfel É two two two two", "a\x0bb\x1cc d\u2028e f", edge.EN]:
        assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("depth", [0, 4])
def test_trie_pairs_equal_all_pairs(depth):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    every = np.unique(np.concatenate([base, near, near ^ np.uint64(3)]))
    own = every[(every >> np.uint64(60)) == np.uint64(5)] if depth else every
    i, j = trie_pairs(own, every, depth, 2)
    want = np.bitwise_count(own[:, None] ^ every[None, :]) <= 2
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(want))))
    assert len(i) == want.sum()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (205, 201), (203, 205)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(21)}, **{100 + k: 100 for k in range(40)}, 201: 201, 203: 201, 205: 201}
    assert got == want


def test_near_copies_and_edges_match_brute_force(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(r[0], r[1]) for r in edge.rows() if r[0] != 7]
    for i in range(100, 160):
        text = [random.choice(words) for _ in range(200)]
        rows.append((i, " ".join(text)))
        text[random.randrange(200)] = "changed"
        rows.append((i + 1000, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    assert edge.listed(simhash_components(df)) == want
    assert len({c for _, _, c in want}) < len(rows) - 10


def test_edges_empty_and_clashing_columns(spark):
    assert simhash_components(edge.empty(spark)).count() == 0
    assert edge.listed(simhash_components(edge.clashing(edge.docs(spark)))) == edge.listed(simhash_components(edge.docs(spark)))


def test_one_document_of_each_group_stays(spark):
    df = edge.clashing(edge.docs(spark))
    left = drop_near_duplicates(df)
    assert left.columns == df.columns
    found = simhash_components(edge.docs(spark)).select("component_id").distinct().count()
    assert left.count() == found
    assert {1, 9} <= {r["doc_id"] for r in left.collect()} and 2 not in {r["doc_id"] for r in left.collect()}
    assert drop_near_duplicates(edge.empty(spark)).count() == 0


def test_a_large_group_of_copies_is_one_fingerprint(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, F.lit(edge.EN)).otherwise(F.concat(F.lit("x y z "), F.col("id").cast("string"))).alias("text"))
    got = simhash_components(df).groupBy("component_id").count().orderBy(F.desc("count")).first()
    assert (got["component_id"], got["count"]) == (0, 2000)


def test_columns_of_any_name_and_type(spark):
    df = edge.docs(spark).selectExpr("*", "lang AS `meta.lang`", "map(coalesce(lang, '-'), doc_id) AS `a``b`", "struct(map('x', text) AS m) AS s")
    left = drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(map(str, (r["doc_id"] for r in left.collect()))) == sorted(map(str, (r["doc_id"] for r in drop_near_duplicates(edge.docs(spark)).collect())))


def test_components_of_repeated_loose_and_null_links(spark):
    from panelscope.llm.components import components

    links = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (2, 5), (None, 7), (9, 8), (8, None)], "a long, b long")
    assert edge.listed(components(links)) == [(1, 1), (2, 1), (5, 1), (8, 8), (9, 8)]
    assert components(links.where("false")).count() == 0
