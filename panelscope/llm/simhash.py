"""SimHash near-duplicates by a self-join of the binary trie of all fingerprints.

A document's 64-bit fingerprint has a bit set where over half of its word shingles' XXH64
hashes have it. Fingerprints that differ in at most ``bits`` bits are linked.

The self-join walks pairs of trie nodes of equal depth together, from the root: the pair's
differing bits so far are added up and the pair is dropped when they exceed the budget. The
first levels are walked by Spark: a fingerprint is sent to its own node of depth d and to the
smaller nodes whose prefix differs in at most ``bits`` bits, with d so deep that no node holds
more than NODE_SIZE distinct fingerprints. Below, each node's task walks the pairs of subtrees
level by level on sorted arrays, where a subtree is a range; pairs of small ranges are compared
at once. A task gives back a spanning forest of its links, not the links.

Copies are one fingerprint, so groups of copies cost nothing here; a fingerprint has at most
C(64, 1) + C(64, 2) linked ones for two bits, so links do not grow with the square of a group.

Edge cases: a null text, or one without words, has fingerprint zero and is linked like any
other; with fewer words than a shingle the whole sequence is the shingle; hashes are counted in
parts, so a text may be of any length; a null id is never a component's smallest id unless
all its ids are null; repeated rows are documents of their own; no documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import kept, row_hash
from panelscope.llm.components import components

SEED = 42
PART = 1 << 16  # shingles hashed at a time
NODE_SIZE = 2048  # distinct fingerprints under a node that one task gets as its own
FRONTIER = 1 << 20  # node pairs walked at a time
LEAF = 16  # pairs of ranges with at most so many pairs of fingerprints are compared at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text (see the module's edge cases)."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, PART):
        to = min(n, at + PART)
        spans = zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
        planes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += planes.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def fingerprint_of(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return hashed(text)


def trie_pairs(own: np.ndarray, other: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with own[i], other[j] differing in at most ``bits`` bits. Both arrays
    are sorted and unsigned; ``own`` shares its first ``depth`` bits."""
    found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if not len(own) or not len(other):
        return found_i[0], found_j[0]
    shift = np.uint64(64 - depth)
    prefix = other >> shift if depth else np.zeros_like(other)
    lo = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
    hi = np.append(lo[1:], len(other))
    err = np.bitwise_count(prefix[lo] ^ (own[0] >> shift if depth else np.uint64(0))).astype(np.int64)
    zeros: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def zeros_upto(t: int):
        if t not in zeros:
            zeros[t] = tuple(np.concatenate(([0], np.cumsum(((x >> np.uint64(t)) & np.uint64(1)) == 0))) for x in (own, other))
        return zeros[t]

    todo = [(63 - depth, np.stack([np.zeros_like(lo), np.full_like(lo, len(own)), lo, hi, err])[:, err <= bits])]
    while todo:
        t, pairs = todo.pop()
        if pairs.shape[1] > FRONTIER:
            todo += [(t, part) for part in np.array_split(pairs, -(-pairs.shape[1] // FRONTIER), axis=1)]
            continue
        rows, columns = pairs[1] - pairs[0], pairs[3] - pairs[2]
        small = (rows * columns <= LEAF) | (t < 0)
        if small.any():
            leaf, n, m = pairs[:, small], rows[small], columns[small]
            sizes = n * m
            which = np.repeat(np.arange(len(sizes)), sizes)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            i, j = leaf[0][which] + nth // m[which], leaf[2][which] + nth % m[which]
            near = np.bitwise_count(own[i] ^ other[j]) <= bits
            found_i.append(i[near])
            found_j.append(j[near])
            pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        za, zb = zeros_upto(t)
        a_lo, a_hi, b_lo, b_hi, err = pairs
        a_mid, b_mid = a_lo + za[a_hi] - za[a_lo], b_lo + zb[b_hi] - zb[b_lo]
        children = [
            np.stack([a0, a1, b0, b1, err + differs])
            for a0, a1, b0, b1, differs in (
                (a_lo, a_mid, b_lo, b_mid, 0),
                (a_mid, a_hi, b_mid, b_hi, 0),
                (a_lo, a_mid, b_mid, b_hi, 1),
                (a_mid, a_hi, b_lo, b_mid, 1),
            )
        ]
        below = np.concatenate(children, axis=1)
        below = below[:, (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= bits)]
        if below.shape[1]:
            todo.append((t - 1, below))
    return np.concatenate(found_i), np.concatenate(found_j)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A star forest with the components of the links (a[i], b[i]): each node and its root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    return nodes, [root(x) for x in nodes]


def _node_depth(distinct: DataFrame) -> int:
    """The least even depth at which no node holds more than NODE_SIZE fingerprints."""
    n = distinct.count()
    depth = max(0, (max(1, n) - 1) // NODE_SIZE).bit_length()
    depth += depth % 2
    while depth < 64:
        if not depth:
            return 0
        prefix = F.shiftrightunsigned("fp", 64 - depth)
        largest = distinct.groupBy(prefix.alias("p")).count().agg(F.max("count")).first()[0]
        if (largest or 0) <= NODE_SIZE:
            return depth
        depth += 2
    return depth


def linked_fingerprints(distinct: DataFrame, bits: int) -> DataFrame:
    """distinct: the column fp. A forest (a, b) that connects the fingerprints exactly as the
    links of at most ``bits`` differing bits do."""
    depth = _node_depth(distinct)
    if depth >= 64:
        raise ValueError("the trie is deeper than a fingerprint")
    masks = [m for m in _masks(depth, bits)]
    prefix = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
    nodes = F.filter(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: prefix.bitwiseXOR(m)), lambda c: c <= prefix)
    sent = distinct.select("fp", F.explode(nodes).alias("node"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(group["fp"].to_numpy().view(np.uint64))
        node = np.uint64(group["node"].iloc[0])
        own = fps[(fps >> np.uint64(64 - depth)) == node] if depth else fps
        i, j = trie_pairs(own, fps, depth, bits)
        a, b = own[i], fps[j]
        other = a != b
        nodes, roots = forest(a[other].view(np.int64), b[other].view(np.int64))
        return pd.DataFrame({"a": np.array(nodes, np.int64), "b": np.array(roots, np.int64)})

    return sent.groupBy("node").applyInPandas(walk, "a long, b long")


def _masks(depth: int, bits: int) -> list[int]:
    masks = {0}
    for _ in range(min(bits, depth)):
        masks |= {m ^ (1 << i) for m in masks for i in range(depth)}
    return sorted(masks)


def component_map(marked: DataFrame, bits: int) -> DataFrame:
    """marked: the columns id and fp. One row per distinct fp: fp, component_id."""
    distinct = kept(marked.groupBy("fp").agg(F.min("id").alias("smallest")))
    linked = components(linked_fingerprints(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    members = kept(linked.join(distinct, "fp"))
    smallest = kept(members.groupBy("root").agg(F.min("smallest").alias("component_id")))
    groups = members.select("fp", "root").join(smallest, "root").select("fp", F.col("component_id").alias("of_group"), F.lit(True).alias("grouped"))
    own = F.when(F.col("grouped"), F.col("of_group")).otherwise(F.col("smallest"))
    return kept(distinct.join(groups, "fp", "left").select("fp", own.alias("component_id")))


def simhash_components(
    docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id."""
    marked = kept(docs.select(F.col(id_col).alias("id"), fingerprint_of(F.col(text_col), shingle).alias("fp")))
    found = marked.join(component_map(marked, bits), "fp")
    return found.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that with the smallest id
    (null last), and of rows that share it the one that comes first by its columns' hash."""
    key = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), row_hash(docs).alias("h"))
    marked = kept(docs.select(key.alias("key"), F.col(id_col).alias("id"), fingerprint_of(F.col(text_col), shingle).alias("fp")))
    fps = marked.select(F.col("key").alias("id"), "fp")
    stay = component_map(fps, bits).select(F.col("component_id").alias("stay")).distinct()
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    parts = lambda c: [F.col(f"{c}.n"), F.coalesce(F.col(f"{c}.id").cast("string"), F.lit("")), F.col(f"{c}.h")]
    same = [a == b for a, b in zip(parts("key"), parts("stay"), strict=True)]
    first = rows.join(stay, same[0] & same[1] & same[2], "left_semi")
    repeated = first.withColumn("nth", F.row_number().over(_by_key()))
    return repeated.where("nth = 1").select("row.*")


def _by_key():
    from pyspark.sql import Window

    return Window.partitionBy("key").orderBy(F.lit(1))
