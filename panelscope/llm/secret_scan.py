"""Secret scans: known patterns, and sliding windows of high Shannon entropy.

Known patterns (kinds assign, access, hex) are matched leftmost and without overlap, per
kind. Other candidate strings are runs of key characters. Per character class, a window of
fixed length slides over each of the run's stretches of that class; the counts of its
characters, and with them the sum of c log2 c, change by one character in and one out. Windows
whose entropy reaches the class's bound and that mix letters and digits are joined to spans of
the kind ``entropy``. Spans that an allow-list pattern covers are left out; known patterns'
spans are cut out of the others, and every part that remains is a span. An allow-list word
(example, changeme ..) allows the segment between / and = that holds it, not the run around it.

Each text is read whole by one Python call; a task holds one Arrow batch. Spans are code
points with the end exclusive.

Edge cases: null and empty texts have no spans; repeated rows are scanned each; a text of any
length is scanned once, in linear time; no documents give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The known patterns, the group that must be long enough and its least length.
KINDS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
ASSIGN_WORDS = ("passw", "secret", "token", "api")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Character class: its stretches, and the least entropy in bits of a window (at most log2 20 = 4.32).
CLASSES = {
    "hex": (r"[0-9a-fA-F]{20,}", 3.0),
    "alnum": (r"[A-Za-z0-9]{20,}", 3.7),
    "base64": (r"[A-Za-z0-9+/_=-]{20,}", 3.9),
}
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUIDs
    r"[0-9+/_=-]+",  # numbers, dates, rules
    r"(?:[A-Za-z]+[-_/+=])+[A-Za-z]+\d{0,4}",  # words joined by marks
)

# A segment between / and = with one of these words is allowed, but not a long string of letters and digits in it that has none.
ALLOWED_WORDS = r"(?i:example|placeholder|xxxxx|changeme)"
SEGMENT = r"[A-Za-z0-9+_-]+"
STRING = r"[A-Za-z0-9]{20,}"

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def _patterns():
    flags = {"assign": re.ASCII | re.IGNORECASE}
    # group 2 may match either case as it is; only the keyword's letters need the flag
    kinds = [(k, re.compile(p, flags.get(k, re.ASCII)), g, n) for k, (p, g, n) in KINDS.items()]
    classes = [(re.compile(p, re.ASCII), bound) for p, bound in CLASSES.values()]
    return kinds, re.compile(CANDIDATE, re.ASCII), classes, re.compile("|".join(ALLOWED), re.ASCII)


@lru_cache(maxsize=1)
def _words():
    return tuple(re.compile(p, re.ASCII) for p in (ALLOWED_WORDS, SEGMENT, STRING))


def known_spans(text: str) -> list[Span]:
    """Spans of the known patterns, by kind."""
    found: list[Span] = []
    for kind, pattern, group, least in _patterns()[0]:
        if kind == "assign":
            low = text.lower()
            if not any(w in low for w in ASSIGN_WORDS):
                continue
        elif kind == "access" and "AKIA" not in text:
            continue
        elif kind == "hex":
            # a run that is long enough starts where the run starts, so the least length can stand in the pattern
            found += [(kind, m.start(), m.end()) for m in re.finditer(r"[0-9a-f]{24,}", text)]
            continue
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


_PART = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def entropy_windows(run: str, bound: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined windows of ``run`` whose Shannon entropy is at least ``bound`` and that hold both
    a letter and a digit; counts change by one character in and one out."""
    counts: dict[str, int] = {}
    total, digits, letters = 0.0, 0, 0
    spans: list[tuple[int, int]] = []
    top = math.log2(window)
    for i, c in enumerate(run):
        if i >= window:
            old = run[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += _PART[n - 1] - _PART[n]
            digits -= old.isdigit()
            letters -= old.isalpha()
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _PART[n + 1] - _PART[n]
        digits += c.isdigit()
        letters += c.isalpha()
        if i >= window - 1 and digits and letters and top - total / window >= bound - 1e-9:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def stretches(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The parts of the run ``text[start:end]`` outside the strings that an allow-list word allows."""
    word, segment, string = _words()
    if word.search(text, start, end):
        for part in segment.finditer(text, start, end):
            if word.search(text, *part.span()):
                yield start, part.start()
                yield from (m.span() for m in string.finditer(text, *part.span()) if not word.search(text, *m.span()))
                start = part.end()
    yield start, end


def entropy_spans(text: str, known: list[Span]) -> list[Span]:
    """Spans of high entropy outside the known ones and the allow list."""
    _, candidate, classes, allowed = _patterns()
    found: list[tuple[int, int]] = []
    for start, end in (s for run in candidate.finditer(text) for s in stretches(text, *run.span())):
        if end - start < WINDOW or text[start:end].isalpha() or allowed.fullmatch(text, start, end):
            continue
        inside: list[tuple[int, int]] = []
        for pattern, bound in classes:
            for part in pattern.finditer(text, start, end):
                inside += [(part.start() + a, part.start() + b) for a, b in entropy_windows(part.group(), bound)]
        for a, b in sorted(inside):
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], max(b, found[-1][1]))
            else:
                found.append((a, b))
    taken: list[tuple[int, int]] = []  # the known spans' union
    for _, a, b in sorted(known, key=lambda s: s[1:]):
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out, k = [], 0
    for a, b in found:
        if allowed.fullmatch(text, a, b):
            continue
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        at, j = a, k
        while j < len(taken) and taken[j][0] < b:
            if at < taken[j][0]:
                out.append(("entropy", at, taken[j][0]))
            at = taken[j][1]
            j += 1
        if at < b:
            out.append(("entropy", at, b))
    return out


ORDER = {kind: i for i, kind in enumerate([*KINDS, "entropy"])}


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """(known spans, all spans) of a text, by start, then kind."""
    if not text:
        return [], []
    by = lambda s: (s[1], ORDER[s[0]])
    known = sorted(known_spans(text), key=by)
    return known, sorted(known + entropy_spans(text, known), key=by)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with every span, or group of spans that meet, replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a > at or not out:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            known, spans = spans_of(text)
            n = {k: sum(s[0] == k for s in known) for k in KINDS}
            rows.append((*n.values(), hashlib.sha256(written(known).encode()).hexdigest(), written(spans)))
        out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        out.insert(0, "id", batch["id"].array)
        yield out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    schema = "id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows.mapInPandas(_scan, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret in the text replaced by a mark; its length column follows."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, found) if t and (found := spans_of(t)[1]) else t)

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out
