import random
import re
from itertools import permutations

from panelscope.llm.filter_audit import Diagram, audit_filters, neighbour_swaps, order_rows

from . import edge

LABELS = "doc_id long, quality int, toxic int"


def plain_audit(rows, labels):
    """Every order applied to every document, one after the other."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    docs = []
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows),
        }
        docs.append((doc_id, source or "", {f for f, failed in fails.items() if failed}))
    out = []
    for part in {p for _, p, _ in docs}:
        own = [(d, f) for d, p, f in docs if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        found = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                shapley[letter] += len(gone)
                redundant = sum(letter in f and bool(f & set(order[: step - 1])) for _, f in own)
                unique = sum(f == {letter} for _, f in own)
                lost = (sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
                found.append((part, order, step, len(left), len(gone), redundant, unique, *lost, letter))
        out += [(*row[:-1], shapley[row[-1]]) for row in found]
    return sorted(out, key=repr)


def test_every_order_is_visited_by_neighbour_swaps():
    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in neighbour_swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))


def test_swapped_diagram_is_the_one_built_in_that_order():
    random.seed(3)
    counts = {m: (random.randrange(50), random.randrange(5), random.randrange(5)) for m in random.sample(range(32), 19)}
    diagram = Diagram(counts, 5)
    for at in neighbour_swaps(5):
        diagram.swap(at)
        fresh = Diagram({}, 5)
        fresh.order = diagram.order.copy()
        assert diagram.root == fresh._built(0, counts)
    assert len(order_rows(counts, "ABCDE")) == 600 and order_rows({}, "AB")[0] == ("AB", 1, 0, 0, 0, 0, 0, 0, 0)


def test_audit_matches_brute_force(spark):
    random.seed(4)
    rows = [(r[0], r[1], r[3]) for r in edge.rows()]
    words = [f"w{i}" for i in range(300)] + ["UPPER", "A|b", "#x"]
    for i in range(100, 160):
        text = " ".join(random.choices(words if i % 3 else words[:40], k=random.choice([150, 250])))
        rows += [(i, text, f"s{i % 2}")] * random.choice([1, 1, 2]) + [(i + 1000 * random.randrange(3), text, None)]
    rows += [(None, rows[-1][1], "a"), (5000, "", "zz"), (5001, None, "")]
    labels = [(i, random.randrange(2), random.randrange(2)) for i in range(90, 150)] + [(100, 1, None), (100, 0, 1), (None, 1, 1), (101, None, None)]
    docs = spark.createDataFrame([(d, t, None, s, 0) for d, t, s in rows], edge.DOCS)
    known = spark.createDataFrame(labels, LABELS)
    want = plain_audit(rows, labels)
    assert edge.listed(audit_filters(docs, known)) == want
    assert edge.listed(audit_filters(edge.clashing(docs), known)) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert audit_filters(edge.empty(spark), none).count() == 0
    rows = [(r[0], r[1], r[3]) for r in edge.rows()]
    assert edge.listed(audit_filters(edge.docs(spark), none)) == plain_audit(rows, [])


def test_counts_do_not_grow_with_a_group_of_copies(spark):
    from pyspark.sql import functions as F

    from panelscope.llm.filter_audit import counted_masks

    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(edge.EN).alias("text"), F.lit("a").alias("source"))
    got = counted_masks(docs, spark.createDataFrame([], LABELS)).collect()
    assert sorted((r["mask"] & 16, r["n"]) for r in got) == [(0, 1), (16, 1999)]
