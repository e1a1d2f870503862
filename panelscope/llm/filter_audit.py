"""How filters interact: kept, removed and redundant rows of every order of a set of filters.

A document's failures are one bit mask. The documents are counted by (part, mask), and each part's
counts make a count-weighted decision diagram: level i tests the i-th filter of the order, the low
child holds the documents that pass it, the high child those that fail it, a node's weight is the
sum of the counts below it, and equal nodes of a level are one. The orders are visited so that
each differs from the one before by one swap of neighbours, and the diagram is reordered by swapping
those two levels (the nodes above are relinked, those below stay as they are). The path that passes
every filter gives an order's steps: its low weights are what is kept, its high ones what goes.

Work on documents is one scan, the counts by mask and the comparison of equal texts by their SHA-256;
a part's counts are at most 4 x 2^filters rows, whatever its size, so a hot source or a large group of
copies is aggregated before it is shuffled, and what a diagram holds doesn't grow with the data.

Edge cases: a null text is empty and a null source is the part of the empty string; a document of
no words has none repeated and fails A only; a null id is no smaller id and has none (it never
fails E, and no document fails E by it); repeated rows of an id are documents of their own, equal to
no smaller id; several labels of an id count as one with the largest quality and toxic; labels of
unknown or null ids, and further columns of either table, are not read; texts of any length are
judged whole; no documents give no rows. The result doesn't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import UPPER, kept, text_words

Weight = tuple[int, int, int]  # documents, good ones, toxic ones
NONE: Weight = (0, 0, 0)
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


class Diagram:
    """Count-weighted decision diagram of failure masks under a variable order.

    A node is (weight, low, high); low and high are nodes of the next level, None below the last.
    """

    def __init__(self, counts: dict[int, Weight], variables: int):
        self.order = list(range(variables))
        self._unique: dict[tuple, tuple] = {}
        self.root = self._built(0, counts)

    def _leaf(self, weight: Weight) -> tuple:
        return self._unique.setdefault((weight,), (weight, None, None))

    def _node(self, level: int, low: tuple, high: tuple) -> tuple:
        key = (level, id(low), id(high))
        if key not in self._unique:
            a, b = low[0], high[0]
            self._unique[key] = ((a[0] + b[0], a[1] + b[1], a[2] + b[2]), low, high)
        return self._unique[key]

    def _built(self, level: int, counts: dict[int, Weight]) -> tuple:
        if level == len(self.order):
            return self._leaf(counts.get(0, NONE))
        bit = 1 << self.order[level]
        low = {m: w for m, w in counts.items() if not m & bit}
        high = {m & ~bit: w for m, w in counts.items() if m & bit}
        return self._node(level, self._built(level + 1, low), self._built(level + 1, high))

    def swap(self, level: int) -> None:
        """Exchange the variables of ``level`` and the next one."""
        done: dict[int, tuple] = {}

        def relinked(node: tuple, at: int) -> tuple:
            if id(node) not in done:
                _, low, high = node
                if at < level:
                    new = self._node(at, relinked(low, at + 1), relinked(high, at + 1))
                else:
                    new = self._node(at, self._node(at + 1, low[1], high[1]), self._node(at + 1, low[2], high[2]))
                done[id(node)] = new
            return done[id(node)]

        self.root = relinked(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, Weight, Weight]]:
        """(variable, kept, removed) along the path that passes every test."""
        out, node = [], self.root
        for variable in self.order:
            out.append((variable, node[1][0], node[2][0]))
            node = node[1]
        return out


def neighbour_swaps(n: int) -> Iterator[int]:
    """Places of n! - 1 swaps of neighbours that visit every order of n things once: the last
    thing runs from one end to the other between two swaps of the others."""
    if n < 2:
        return
    down = True
    for inner in [*neighbour_swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            yield inner + 1 if down else inner  # the last thing stands first or last
        down = not down


def order_rows(counts: dict[int, Weight], letters: str) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)
    of every order of ``letters``; ``counts`` has a weight by failure mask (bit i: letters[i])."""
    fails = [sum(w[0] for m, w in counts.items() if m >> i & 1) for i in range(len(letters))]
    unique = [counts.get(1 << i, NONE)[0] for i in range(len(letters))]
    diagram = Diagram(counts, len(letters))
    orders = [(diagram.order.copy(), diagram.steps())]
    for place in neighbour_swaps(len(letters)):
        diagram.swap(place)
        orders.append((diagram.order.copy(), diagram.steps()))
    shapley = [0] * len(letters)
    for _, steps in orders:
        for variable, _, removed in steps:
            shapley[variable] += removed[0]
    return [
        ("".join(letters[v] for v in order), nth, left[0], gone[0], fails[v] - gone[0], unique[v], gone[1], gone[2], shapley[v])
        for order, steps in orders
        for nth, (v, left, gone) in enumerate(steps, 1)
    ]


def interaction_audit(counted: DataFrame, letters: str) -> DataFrame:
    """counted: part, mask (bit i set: fails letters[i]), n, good, toxic (longs; good and toxic
    of the n documents), at most one row per part and mask. One row per part, order and step."""
    weight = F.struct("mask", "n", "good", "toxic")
    parts = counted.groupBy("part").agg(F.collect_list(weight).alias("counts"))  # at most 2^filters entries

    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            for part, counts in zip(batch["part"], batch["counts"], strict=True):
                masks = {int(c["mask"]): (int(c["n"]), int(c["good"]), int(c["toxic"])) for c in counts}
                rows = [(part, *row) for row in order_rows(masks, letters)]
                yield pd.DataFrame(rows, columns=names)

    return parts.mapInPandas(audit, RESULT)


def text_failures(text: Column) -> list[Column]:
    """Failure conditions A to D of a non-null text."""
    words = text_words(text)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * upper > 2 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def mask_of(failures: Sequence[Column]) -> Column:
    out = F.lit(0)
    for i, failed in enumerate(failures):
        out = out + F.when(failed, 1 << i).otherwise(0)
    return out


def counted_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by their failures of A to E."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    marked = read.select(
        "doc_id", "part", mask_of(text_failures(F.col("text"))).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")
    )
    per_id = marked.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad")
    )
    is_set = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    labelled = per_id.join(known, "doc_id", "left").select(*per_id.columns, is_set("good"), is_set("bad"))
    # Of each group of equal texts: its rows, its smallest id and that id's rows, per part and labels.
    groups = kept(
        labelled.groupBy("digest", "part", "mask", "good", "bad").agg(
            F.sum("n").alias("n"),
            F.min("doc_id").alias("least"),
            F.min_by("n", "doc_id").alias("at_least"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        )
    )
    first = kept(groups.groupBy("digest").agg(F.min("least").alias("first")))
    first_rows = F.col("no_id") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), first_rows.alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - first_rows).alias("n")),
    )
    split = groups.join(first, "digest").select("part", "good", "bad", F.explode(both).alias("x")).where("x.n > 0")
    return split.groupBy("part", "x.mask").agg(
        F.sum("x.n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("bad"), F.col("x.n")).otherwise(0)).alias("toxic"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of ABCDE and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley (see the module)."""
    return interaction_audit(counted_masks(docs, labels), "ABCDE")
