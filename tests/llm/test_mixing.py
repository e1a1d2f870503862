import random

from pyspark.sql import functions as F

from panelscope.llm.mixing import mix, mixed_documents, source_targets

from . import edge


def plain_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        rest, dealt = total - sum(full.values()), sum(weight[s] for s in open_)
        target = {s: rest * weight[s] / dealt for s in open_}
        above = [s for s in open_ if target[s] > most * sizes[s]]
        if not above:
            return full | target
        full |= {s: most * sizes[s] for s in above}


def targets(spark, sizes, *args):
    df = spark.createDataFrame(list(sizes.items()), "source string, n long")
    return {r["source"]: r["target"] for r in source_targets(df, *args).collect()}


def test_targets_follow_weights_and_stop_at_the_most(spark):
    sizes = {"b": 100, "a": 1000, None: 50, "c": 400}
    # of 2325 words, by 3 : 1 : 2 : 3, b stops at 200 and null at 100; of the other 2025, by 3 : 2, c stops at 800
    assert targets(spark, sizes, (3, 1, 2), 1.5, 2) == {"a": 1225.0, "b": 200, "c": 800, None: 100}
    assert targets(spark, {"a": 0}, (1,), 1.5, 2) == {"a": 0}
    assert targets(spark, {"a": 5, "b": 7}, (1,), 2, 2) == {"a": 10, "b": 14}


def test_targets_of_very_many_sources_match_plain_dealing(spark):
    random.seed(1)
    sizes = {f"site{i}\u00e9" if i % 3 else f"{i}": int(random.paretovariate(0.6)) for i in range(3000)} | {None: 77}
    got, want = targets(spark, sizes, (3, 1, 2), 1.5, 2), plain_targets(sizes, (3, 1, 2), 1.5, 2)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * want[s] for s in want)


def corpus(spark):
    n = 4000
    return spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("source"),
        F.repeat(F.lit("word "), (F.col("id") % 90).cast("int")).alias("text"),
    )


def test_each_source_comes_near_its_target(spark):
    df = corpus(spark)
    rows = mix(df).collect()
    assert len(rows) == df.count()
    per = {}
    source = {r["doc_id"]: r["source"] for r in df.select("doc_id", "source").collect()}
    for r in rows:
        s = per.setdefault(source[r["doc_id"]], [0, r["target"], r["source_size"], 0])
        s[0] += r["taken"]
        s[3] += r["size"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for taken, target, size, counted in per.values():
        assert counted == size and target <= 2 * size and abs(taken - target) <= 2 * 90
    total = sum(s[3] for s in per.values())
    assert abs(sum(s[0] for s in per.values()) - 1.5 * total) <= 90


def test_the_order_matches_one_queue_in_one_place(spark):
    rows = mix(corpus(spark)).collect()
    source = {r["doc_id"]: r["source"] for r in corpus(spark).select("doc_id", "source").collect()}
    place = lambda r: (r["at"] >> 33) % (1 << 31)
    queue, sent = [], {}
    for r in sorted(rows, key=lambda r: (place(r), r["at"], r["doc_id"])):
        s = source[r["doc_id"]]
        sent[s] = sent.get(s, 0) + r["size"]
        for k in (0, 1):
            queue.append(((sent[s] + k * r["source_size"]) / r["target"], r["at"], r["doc_id"], r["size"]))
    budget, taken, run = sum({source[r["doc_id"]]: r["target"] for r in rows}.values()), {}, 0
    last = None
    for finish, _, doc, size in sorted(queue):
        run += size
        if run - size / 2 <= budget or finish == last:
            last = finish
            taken[doc] = taken.get(doc, 0) + size
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: taken.get(r["doc_id"], 0) for r in rows}


def test_reruns_agree(spark):
    assert edge.listed(mix(corpus(spark).repartition(7))) == edge.listed(mix(corpus(spark).coalesce(1)))


def test_edges(spark):
    plain = edge.listed(mix(edge.docs(spark)))
    assert edge.listed(mix(edge.clashing(edge.docs(spark)))) == plain
    assert len(plain) == len(edge.rows())
    assert all(r[1] == 0 and r[4] == 0 for r in plain if r[0] in (4, 5, 6))
    assert mix(edge.empty(spark)).count() == 0
    nothing = mix(edge.docs(spark).where("doc_id in (4, 5)")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)] * 2


def test_taken_rows_come_as_often_as_they_are_taken(spark):
    df = edge.clashing(edge.docs(spark))
    taken = sum(r["taken"] // r["size"] for r in mix(edge.docs(spark)).collect() if r["size"])
    out = mixed_documents(df)
    assert out.columns == df.columns and out.count() == taken
    assert mixed_documents(edge.empty(spark)).count() == 0


def test_reruns_keep_the_same_of_rows_that_differ_elsewhere(spark):
    rows = [(1, "a b c d", "en", "s", n) for n in range(6)] + [(i, "w " * i, "en", "t", i) for i in range(2, 30)]
    df = spark.createDataFrame(rows, edge.DOCS).selectExpr("*", "map('a', n_chars) AS `m.ap`")
    one = edge.listed(mixed_documents(df.repartition(5)))
    assert one == edge.listed(mixed_documents(df.coalesce(1).orderBy("n_chars"))) and len(one) > 30
