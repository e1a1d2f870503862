"""Language identification: averaged embeddings of hashed subwords with a linear softmax,
trained by stochastic gradient descent in numpy, with calibrated rejection.

A text's letters, lower-cased, form words between borders (every run of other characters is
one border). Its subwords are the n-grams of 1 to 4 characters that do not cross a border;
each is hashed to a bucket with an embedding. The mean embedding gives the logits. As the
softmax is linear, prediction adds up one row of logits per subword (embeddings times weights)
over the whole text, in tasks that hold one Arrow batch; only the model goes to the tasks.

Training reads a bounded sample: at most ``max_docs`` labelled documents, shared evenly among
the languages, the first of each by a hash, and of each at most ``fragments`` pieces of ``piece``
characters drawn from all over its text (so that no long document outweighs the others). A fifth of these documents calibrate: the softmax temperature that fits their
pieces best, and the bounds below which a text is rejected, which all but ``rejected`` of the calibration
pieces reach:

- its score, of the pieces that are right; a text in two languages has about half for each, so
  it stays when its two best scores together reach the bound, or its familiarity is less than half
  way to its own bound;
- its familiarity, the mean of its subwords' log frequencies, each in the learned language that
  has it most often: high in any mix of learned languages, low in others, however sure the softmax
  is. The deviation from the calibration pieces' median, times the root of the number of subwords
  (short texts vary more; longer ones count as a whole piece), is bounded. Passages in another
  language than the label's are left out of this bound: what lies beyond STRAY deviations.

With fewer than LEAST_PIECES calibration pieces there is no bound on familiarity: the lowest of so
few says little about a quantile of 0.001, and a bound that is too high would reject clean texts.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled
row every text is; rows with a null label are not learned from; texts over TEXT_PART characters are
read in parts that end at a space or line break, or else at another border, so no subword is lost
and memory is bounded by the part (or by one word that is longer); an empty table has no
rows; repeated rows count as often as they appear in the sample; other columns are never inputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 15
DIM = 16
ORDERS = (1, 2, 3, 4)
MAX_DOCS = 1600
FRAGMENTS = 4  # parameters of fit, as is the next
PIECE = 200
EPOCHS = 4
RATE = 0.5
LEAST_PIECES = 50  # for a bound on familiarity
STRAY = 8  # standard deviations, by the median: calibration pieces beyond are of another language than their label
SPAN = 1 << 31
TEXT_PART = 1 << 17
BATCH_CHARS = 1 << 17  # texts are judged together up to so many characters
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    logits: np.ndarray  # BUCKETS x labels: embeddings times weights, over the temperature
    bias: np.ndarray
    least: float  # scores below are rejected, unless the two best together reach it or the text is familiar
    logs: np.ndarray  # of each bucket: log frequency in the language that has it most often
    usual: float  # median familiarity of the calibration pieces
    spread: float  # familiarity below usual - spread / sqrt(subwords, at most full) is rejected
    full: int  # subwords of a whole piece


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _parts(text: str) -> Iterator[str]:
    """``text`` in parts that end before a border: of at most TEXT_PART characters, or one word."""
    at = 0
    while len(text) - at > TEXT_PART:
        cut = max(text.rfind(" ", at + 1, at + TEXT_PART), text.rfind("\n", at + 1, at + TEXT_PART))
        if cut <= at:
            cut = at + TEXT_PART
            while cut > at and text[cut].isalpha():
                cut -= 1
        if cut <= at:
            cut = at + TEXT_PART
            while cut < len(text) and text[cut].isalpha():
                cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every subword of all texts, number of subwords of each text)."""
    joined = "\0".join(t.lower().replace("\0", " ") for t in texts)
    codes = np.frombuffer(f"\0{joined}\0".encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(codes == 0)  # text i lies between ends[i] and ends[i + 1]
    x = np.where(_letters()[codes], codes, 0).astype(np.uint64)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    keep[ends] = True  # the borders of texts stay, so that no text is lost
    owner = np.repeat(np.arange(len(ends)), np.diff(np.append(ends, len(x))))[keep]
    x = x[keep]
    counts = np.zeros(len(texts), np.int64)
    found, owners = [], []
    h = np.zeros(len(x), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + x[n - 1 :]
        if n not in ORDERS:
            continue
        if n == 1:
            valid = x != 0
        else:
            valid = (x[:m] != 0) | (x[1 : m + 1] != 0) if n == 2 else np.ones(m, bool)
            for k in range(1, n - 1):
                valid &= x[k : k + m] != 0
        start = np.flatnonzero(valid)
        mixed = (h[start] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
        owners.append(owner[start + (x[start] == 0)])  # of the n-gram's first letter
    if not found:
        return np.empty(0, np.int32), counts
    ids, own = np.concatenate(found), np.concatenate(owners)
    own = np.minimum(own, len(texts) - 1)
    order = np.argsort(own, kind="stable")
    return ids[order], np.bincount(own, minlength=len(texts))


def _averages(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of the consecutive groups of ``rows``; zero for empty groups."""
    out = np.zeros((len(counts), rows.shape[1]))
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(rows, starts, axis=0, dtype=np.float64) / counts[full, None]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(pieces: list[str], labels: list[str], calibrate: list[bool], rejected: float = 0.001, seed: int = 7) -> Model:
    """A model of ``pieces`` and their ``labels``; those marked in ``calibrate`` only calibrate."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    held = np.array(calibrate, bool)
    if held.all() or not held.any():
        held = np.zeros(len(y), bool)
    ids, counts = subwords(pieces)
    stops = np.cumsum(counts)
    starts = stops - counts
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / math.sqrt(DIM), (BUCKETS, DIM))
    weights = np.zeros((DIM, len(names)))
    bias = np.zeros(len(names))
    learn = np.flatnonzero(~held & (counts > 0))
    steps, done = max(1, EPOCHS * -(-len(learn) // 32)), 0
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for at in range(0, len(learn), 32):
            rows = learn[at : at + 32]
            rate = RATE * (1 - done / steps)
            done += 1
            n = counts[rows]
            bag = np.concatenate([ids[starts[r] : stops[r]] for r in rows])
            mean = _averages(table[bag], n)
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            back = error @ weights.T / n[:, None]
            weights -= rate * mean.T @ error / len(rows)
            bias -= rate * error.mean(axis=0)
            np.add.at(table, bag, -rate * 8 * np.repeat(back, n, axis=0))
    logits = table @ weights
    z = _averages(logits[ids], counts) + bias
    test = np.flatnonzero((held if held.any() else np.ones(len(y), bool)) & (counts > 0))
    right = y[test]
    loss = {}
    for t in np.geomspace(0.02, 4, 40):
        p = _softmax(z[test] / t)
        loss[t] = -np.log(np.maximum(p[np.arange(len(test)), right], 1e-12)).mean() if len(test) else 0.0
    t = min(loss, key=loss.get) if len(test) else 1.0
    p = _softmax(z[test] / t) if len(test) else np.ones((0, len(names)))
    good = p[np.arange(len(test)), right][p.argmax(axis=1) == right] if len(test) else np.empty(0)
    least = float(np.quantile(good, rejected)) if len(good) else 0.0
    logs = _log_frequencies(ids, counts, y, np.flatnonzero(~held & (counts > 0)), len(names))
    usual, spread, full = 0.0, math.inf, 1
    if held.any() and len(test) >= LEAST_PIECES:
        own = _averages(logs[ids][:, None], counts)[test, 0]
        full = int(counts[test].max())
        usual = float(np.median(own))
        off = (own - usual) * np.sqrt(counts[test])
        spread = -float(np.quantile(off, rejected))
        scale = 1.4826 * float(np.median(np.abs(off)))  # of a normal distribution, the standard deviation
        if scale > 0:
            spread = min(spread, STRAY * scale)
    return Model(names, (logits / t).astype(np.float32), bias / t, least, logs.astype(np.float32), usual, spread, full)


def _log_frequencies(ids: np.ndarray, counts: np.ndarray, y: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Log frequency of every bucket, add-one smoothed, in the language that has it most often."""
    owner = np.repeat(np.arange(len(counts)), counts)
    mine = np.isin(owner, rows)
    seen = np.bincount(y[owner[mine]] * BUCKETS + ids[mine], minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.log((seen + 1) / (seen.sum(axis=1, keepdims=True) + BUCKETS)).max(axis=0)


def judged(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """(label, score, rejected) of each text."""
    n = len(texts)
    if model is None:
        return [UNKNOWN] * n, [0.0] * n, [True] * n
    rows_of = np.column_stack([model.logits, model.logs])  # one gather for both
    sums, counts = np.zeros((n, rows_of.shape[1])), np.zeros(n, np.int64)
    group: list[tuple[int, str]] = []
    size = 0

    def flush() -> None:
        if group:
            ids, found = subwords([p for _, p in group])
            means = _averages(rows_of[ids], found)
            rows = [i for i, _ in group]
            np.add.at(sums, rows, means * found[:, None])
            np.add.at(counts, rows, found)
            group.clear()

    for i, text in enumerate(texts):
        for part in _parts(text or ""):
            if size + len(part) > BATCH_CHARS:
                flush()
                size = 0
            group.append((i, part))
            size += len(part)
    flush()
    known = counts > 0
    sums /= np.maximum(counts, 1)[:, None]
    p = _softmax(sums[:, :-1] + model.bias)
    best = p.argmax(axis=1)
    two = np.sort(p, axis=1)[:, -2:].sum(axis=1)  # a text in two languages has about half for each
    short = (model.usual - sums[:, -1]) * np.sqrt(np.clip(counts, 1, model.full)) - 1e-6
    bounded = math.isfinite(model.spread)
    doubtful = short > model.spread / 2 if bounded else known
    unsure = (two < model.least - 1e-6) & doubtful
    return (
        [model.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
        np.where(known, p[np.arange(n), best], 0.0).tolist(),
        (~known | unsure | (short > model.spread)).tolist(),
    )


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """(label, score) of each text."""
    return judged(model, texts)[:2]


def held_out(id_col: str) -> Column:
    """Documents that are never learned from: crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _cut_pieces(fragments: int, piece: int):
    """The first two of a text's pieces have ``piece`` characters, then half and a fifth of them in turn."""
    sizes = [piece, piece, piece // 2, piece // 5]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, label, place in zip(batch["text"], batch["label"], batch["place"], strict=True):
                rng = np.random.default_rng(abs(int(place)))
                starts = rng.integers(0, max(1, len(text) - piece + 1), fragments) if len(text) > piece else [0]
                rows += [(text[s : s + sizes[i % 4]], label, place, i) for i, s in enumerate(sorted({int(s) for s in starts}))]
            yield pd.DataFrame(rows, columns=["piece", "label", "place", "nth"])

    return run


def fit(
    docs: DataFrame,
    max_docs: int = MAX_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    rejected: float = 0.001,
    fragments: int = FRAGMENTS,
    piece: int = PIECE,
) -> Model | None:
    """Fit a model on a sample of at most ``max_docs`` labelled documents, and of each text at most
    ``fragments`` pieces of ``piece`` characters (see above)."""
    label = F.col(label_col).cast("string")
    place = F.xxhash64(F.col(id_col), F.lit("langid"))
    rows = docs.where(~held_out(id_col) & label.isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), label.alias("label"), place.alias("place")
    )
    counts = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_docs).collect()
    if not counts:
        return None
    # a range of the hash that holds about twice each language's share: only these rows are ordered
    quota = -(-max_docs // len(counts))
    spans = [(r["label"], int(min(1.0, 2 * quota / r["count"] + 0.01) * SPAN)) for r in counts]
    spans = F.broadcast(docs.sparkSession.createDataFrame(spans, "of string, span long"))
    near = rows.join(spans, F.col("label") == F.col("of")).where(F.shiftrightunsigned("place", 33) <= F.col("span"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("place", "text"))
    first = near.withColumn("nth", nth).where(F.col("nth") <= quota).orderBy("nth", "place").limit(max_docs)
    pieces = first.select("text", "label", "place").mapInPandas(_cut_pieces(fragments, piece), "piece string, label string, place long, nth int")
    sample = pieces.toPandas().sort_values(["place", "label", "nth", "piece"])
    if not len(sample):
        return None
    return train(sample["piece"].tolist(), sample["label"].tolist(), (sample["place"] % 5 == 0).tolist(), rejected)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, rejected."""
    found = predicted(F.col(text_col), model)
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), found.alias("p")).select(
        id_col, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected")
    )


def predicted(text: Column, model: Model | None) -> Column:
    """Struct of lang, score and rejected."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        lang, score, rejected = judged(model, texts.tolist())
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    return run(text)


def drop_rejected(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is recognised."""
    rows = docs.select(F.struct("*").alias("row"), predicted(F.col(text_col), model).alias("found"))
    return rows.where("not found.rejected").select("row.*")
