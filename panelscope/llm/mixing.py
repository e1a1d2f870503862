"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a fixed shuffled order, finishes at a virtual time: the words
that its source has sent by then, divided by the source's target. All documents are put in
the order of their finish times and the order is cut where the total budget is reached. A
source whose target exceeds its words is sent again from the start (``max_repeats`` rounds).

Both totals (words sent by a source, words of the whole order) are running sums in two levels:
sums per block of the order, a running sum over the blocks, and a window inside each block. A
source that holds a third of all rows is spread over its blocks; the blocks of the global
order are ranges of the finish time, so no task gets the whole order.

At finish time 1 every source has sent its target, less the part of one document. So the cut
lies a little after 1 and each source's words differ from its target by less than its largest
document plus the sources' open parts.

Edge cases: a null text has size 0; a null source is a source of its own (last by order);
documents of size 0 are never taken; repeated rows are documents of their own; the order is
fixed by a hash of id and text, so reruns agree; no documents give no rows; no words at all
give targets of 0; a text of any length is one document of its size; other columns are not read
by the mix, and rows that repeat id and text are told apart by a hash of all columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.llm.common import BROADCAST_BYTES, blocks_for, kept, row_hash, running_total, text_words
from panelscope.operators.rank import positions

ROWS_PER_BLOCK = 2048
HASH_RANGE = 1 << 31


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes: source, n (words), one row per source. Adds weight and target, its words in the mix.

    Sources by code point, null last, get the repeated ``weights``; ``share`` times all words are
    dealt by weight, no source gets more than ``most`` times its words, and what is over is dealt
    again among the others. The sources stay a table, however many there are: their places come from
    ``positions``, and each round of dealing is one aggregate, of which a few sums reach the driver.
    """
    placed = positions(sizes, "source", "source", desc=False)  # nulls first: the null source goes from place 1 to the end
    has_null = sizes.where("source IS NULL").limit(1).count()
    nth = F.when(F.col("source").isNull(), F.col("n_rows") - 1).otherwise(F.col("row_no") - 1 - has_null)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights)).cast("int"))
    table = kept(placed.select("source", "n", weight.alias("weight")))
    limit = F.col("n") * most
    total = share * (table.agg(F.sum("n")).first()[0] or 0)
    full, level = F.lit(False), None
    stopped = -1
    while True:
        row = table.agg(
            F.sum(F.when(full, limit).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count(F.when(full, 1))
        ).first()
        if row[2] == stopped or not row[1]:
            break
        rest, dealt, stopped = total - row[0], row[1], row[2]
        level = F.lit(float(rest)) * F.col("weight") / F.lit(float(dealt))
        full = full | (level > limit)
    target = F.when(full, limit).otherwise(level) if level is not None else limit
    return table.withColumn("target", target.cast("double"))


def with_sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """id, source, size (words) and the place ``at`` of each document in the shuffled order."""
    place = F.xxhash64(F.col(id_col), F.lit("mix"), F.col(text_col))
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.size(text_words(F.col(text_col))).cast("long").alias("size"),
        place.alias("at"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_repeats: int = 2,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, size, source_size, target (of its source), taken (words the
    mix takes: 0, size, .. max_repeats * size), and ``at``, its place in the shuffle."""
    sized = kept(with_sizes(docs, id_col, source_col, text_col))
    rows = sized.count()
    if not rows:
        return _result(sized.withColumns({c: F.lit(0) for c in ("source_size", "target", "taken")}), id_col)
    per_source = kept(sized.groupBy("source").agg(F.sum("size").alias("n")))
    targets = kept(source_targets(per_source, weights, share, max_repeats))
    facts = targets.select(F.col("source").alias("of"), F.col("n").alias("source_size"), "target")
    # decimals: their sum doesn't depend on the order of rows
    n_sources, budget = targets.agg(F.count("*"), F.sum(F.col("target").cast("decimal(28,6)")).cast("double")).first()
    n_blocks = blocks_for(rows, ROWS_PER_BLOCK)

    place = F.pmod(F.shiftrightunsigned("at", 33), F.lit(HASH_RANGE))
    queue = sized.withColumn("block", F.floor(place * n_blocks / HASH_RANGE).cast("long")).withColumn("top", place)
    order = ["top", "at", F.col("id").asc_nulls_last(), "size"]
    sent = running_total(queue, "size", "sent", "block", order, ["source"])
    if n_sources * 256 <= BROADCAST_BYTES:
        facts = F.broadcast(facts)
    sent = sent.join(facts, F.col("source").eqNullSafe(F.col("of"))).drop("of", "block", "top")
    taken = _until_budget(sent, budget, max_repeats, rows)
    return _result(taken, id_col)


def _until_budget(sent: DataFrame, budget: float, repeats: int, rows: int) -> DataFrame:
    """Adds ``taken``: the words of each document's copies up to the cut of the global order."""
    finish = [
        F.when(F.col("target") > 0, (F.col("sent") + k * F.col("source_size")) / F.col("target")) for k in range(repeats)
    ]
    sent = kept(sent)
    copies = sent.select(
        "at", "id", "size", F.explode(F.array(*finish)).alias("finish")
    ).where("size > 0 and finish is not null")
    cut = _cut(copies, budget, rows)
    n = sum((F.when(f <= cut, 1).otherwise(0) for f in finish), F.lit(0))
    return sent.withColumn("taken", F.when(F.col("target") > 0, F.col("size") * n).otherwise(0))


def _cut(copies: DataFrame, budget: float, rows: int) -> Column:
    """The finish time of the last copy that the budget holds. Copies are counted in ranges of
    the finish time; only the range in which the budget ends is put in order."""
    ranges = max(1024, blocks_for(rows, 4096))
    block = F.floor(F.col("finish") * ranges).cast("long")
    sums = copies.groupBy(block.alias("block")).agg(F.sum("size").alias("words"))
    upto = Window.orderBy("block")  # as many rows as ranges
    running = kept(sums.select("block", "words", F.sum("words").over(upto).alias("upto")))
    over = running.where(F.col("upto") > budget).agg(F.min_by(F.struct("block", "words", "upto"), "block").alias("x")).first()
    if over["x"] is None:
        return F.lit(float("inf"))
    last, words, upto_words = over["x"]
    inner = Window.orderBy("finish", "at", F.col("id").asc_nulls_last(), "size")
    left = budget - (upto_words - words)
    crossed = (
        copies.where(block == last)
        .withColumn("run", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("run") - F.col("size") / 2 <= left)
        .agg(F.max("finish"))
        .first()[0]
    )
    return F.lit(math.nextafter(last / ranges, -math.inf) if crossed is None else crossed)


def _result(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(
        F.col("id").alias(id_col),
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        F.col("taken").cast("long").alias("taken"),
        "at",
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken."""
    copies = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    taken = copies.where("taken > 0").select(
        F.col(id_col).alias("mix_id"), F.col("at").alias("mix_at"), (F.col("taken") / F.col("size")).cast("int").alias("times")
    )
    # rows that repeat id and text share a place; the n-th of them, by a hash of all columns, is paired
    # with the n-th taken
    nth = F.row_number().over(Window.partitionBy("mix_id", "mix_at").orderBy(F.desc("times")))
    taken = taken.withColumn("mix_nth", nth)
    place = F.xxhash64(F.col(id_col), F.lit("mix"), F.col(text_col))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), place.alias("row_at"), row_hash(docs).alias("row_hash"))
    rows = rows.withColumn("row_nth", F.row_number().over(Window.partitionBy("row_id", "row_at").orderBy("row_hash")))
    same = (
        F.col("row_id").eqNullSafe(F.col("mix_id"))
        & (F.col("row_at") == F.col("mix_at"))
        & (F.col("row_nth") == F.col("mix_nth"))
    )
    return rows.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
