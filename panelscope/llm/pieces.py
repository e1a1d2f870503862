"""SentencePiece encoding and decoding: N-best segmentation over the piece lattice.

The lattice of a text has an edge for every piece of the vocabulary that stands at a place of
the normalised text; a character that no piece covers is one unknown edge, written as its bytes.
A path's score is the sum of its pieces' scores as the model file holds them. The forward
Viterbi scores of all places are exact heuristics for a search backward from the end: the A*
search pops partial paths by (score so far + Viterbi score of the place), so complete paths
come out best first.

No piece crosses a border between a character and a following space mark, or between a letter
and a mark that follows a letter in no piece, nor touches a character that only stands alone,
so the lattice falls apart into segments there. Each segment
is searched once per task (frequent ones are remembered), and the N-best paths of a text are
searched over its segments in the same way. Only segments whose second-best path costs least
can take part, the N - 1 cheapest, so long texts need no more than that.

Order of equal scores: within a segment, by the piece ids read from the end; between segments,
the path whose later segments keep their better paths comes first.

Edge cases: a null or empty text has one path without pieces and the score 0; texts of any
length are read whole, segment by segment; a segment has no length limit; repeated rows are
encoded each; a text with fewer than N paths has fewer rows; no documents give no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_COST = 10.0  # below the lowest piece score
REMEMBERED = 200_000  # segments held per task, besides those in use
REMEMBERED_CHARS = 1 << 23  # and their characters
SEARCHED = 15_000  # segments whose n best paths are held
LONG = 64  # longer ones are not
TOGETHER = 20_000  # segments walked together
NO_PIECE = -(1 << 40)  # marks the beginning of a piece that is none itself
HASH = 0x9E3779B97F4A7C15
SPREAD = 0xD6E8FEB86659FD93  # odd: different hashes stay different
SLOT_BITS = 19
_ALL = (1 << 64) - 1
_NONE = float("-inf")


class Rows(dict):
    """Row numbers by segment; one that is looked up for the first time gets the next number and
    is listed as ``new``."""

    def __init__(self, known=()):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = row = len(self)
        self.new.append(segment)
        return row


class Learned:
    """The best paths of segments: a row each in arrays, ``rows`` by segment."""

    def __init__(self):
        self.rows = Rows()
        self.chars = 0
        self.score = np.empty(0)  # of the best path
        self.cost = np.empty(0)  # what the second-best path costs more
        self.length = np.empty(0, np.int64)  # piece ids of the best path, and where they begin in flat
        self.start = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)
        self.exact = np.empty(0, bool)  # whether they decode to the segment
        self.again = np.empty(0, bool)  # met in more than one part of the texts

    def add(self, score, cost, length, flat, exact) -> None:
        """The next rows' paths."""
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(length) - length))
        for name, more in (("score", score), ("cost", cost), ("length", length), ("flat", flat), ("exact", exact), ("again", np.zeros(len(score), bool))):
            setattr(self, name, np.concatenate((getattr(self, name), more)))

    def paths(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the best paths of ``rows``, one after the other."""
        length = self.length[rows]
        ends = np.cumsum(length)
        return self.flat[np.repeat(self.start[rows] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]

    def full(self) -> bool:
        return len(self.rows) > REMEMBERED or self.chars > REMEMBERED_CHARS

    def shrunk(self) -> Learned:
        """Only what was met again; nothing, when that is most of what may be held."""
        out = Learned()
        stay = [(x, i) for x, i in self.rows.items() if self.again[i]]
        chars = sum(len(x) for x, _ in stay)
        if len(stay) <= REMEMBERED // 2 and chars <= REMEMBERED_CHARS // 2:
            at = np.array([i for _, i in stay], np.int64)
            out.rows, out.chars = Rows(zip([x for x, _ in stay], range(len(stay)), strict=True)), chars
            out.add(self.score[at], self.cost[at], self.length[at], self.paths(at), self.exact[at])
        return out


class Pieces:
    """A vocabulary with scores, read from the bytes of a SentencePiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        m = self.model
        ids = range(m.get_piece_size())
        plain = [i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.text = [m.id_to_piece(i) for i in ids]
        self.score = [m.get_score(i) for i in ids]
        self.id_of = {self.text[i]: i for i in plain}
        self.steps = {p[:k]: NO_PIECE for p in self.id_of for k in range(1, len(p))} | self.id_of
        # the same as sorted hashes, for many segments at a time
        hashed = sorted((self._hash(p) * SPREAD & _ALL, i) for p, i in self.steps.items())
        self.hashes = np.array([h for h, _ in hashed], np.uint64)
        self.found = np.array([i for _, i in hashed], np.int64)
        if len(np.unique(self.hashes)) < len(self.hashes):
            raise ValueError("two beginnings of pieces share a hash")
        # the first hash of each value of the upper bits, to look hashes up in a few steps
        upper = (self.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slot = np.searchsorted(upper, np.arange((1 << SLOT_BITS) + 1)).astype(np.int32)
        self.scores = np.array(self.score)
        self.byte_id = {int(self.text[i][1:-1], 16): i for i in ids if m.is_byte(i)}
        self.byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.unknown = next((i for i in ids if m.is_unknown(i)), 0)
        self.unknown_score = min((self.score[i] for i in plain), default=0.0) - UNKNOWN_COST
        self.hidden = {i for i in ids if m.is_control(i)}
        # pieces as text; bytes of longer characters have to be joined first
        self.part_of_character = np.array([self.byte_of.get(i, b"a")[0] >= 0x80 for i in ids])
        as_text = lambda i: self.byte_of[i].decode("latin-1") if i in self.byte_of else self.text[i].replace(SPACE, " ")
        self.shown = np.array(["" if i in self.hidden else as_text(i) for i in ids], object)
        joined = {c for p in self.id_of if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in (*range(9, 14),) if chr(c) not in joined)
        crosses = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        rest = f"[^{SPACE}{alone}]+"
        # marks that no piece has right after a letter: a word ends before them
        letter = re.compile(r"[^\W\d_]")
        after = {b for p in self.id_of for a, b in pairwise(p) if letter.match(a)}
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not letter.match(c) and c not in after)
        word = f"{SPACE}*+[^\\W\\d_]++(?=[{marks}])|" if marks else ""
        self.segments = re.compile(f"{word}[{alone or SPACE}]|{SPACE}+(?:{rest})?|{rest}" if not crosses else r"(?s:.+)")
        self.forget()

    def forget(self) -> None:
        """Empty what was remembered of segments."""
        self.learned = Learned()
        self.searched: dict[tuple[str, int], list[tuple[float, tuple[int, ...], bool]]] = {}

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * HASH + ord(c) + 1) & _ALL
        return h

    def normalise(self, text: str) -> str:
        return self.model.normalize(text) if text else ""

    def lattice(self, text: str) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
        """Forward Viterbi: the best score of every place, and by place the edges that end there
        as (start, id, score), the best one first. An unknown character's id is -1 - its code point."""
        size, steps, score = len(text), self.steps, self.score
        best = [0.0] + [_NONE] * size
        edges: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
        for start in range(size):
            before = best[start]
            single = False
            for end in range(start + 1, size + 1):
                piece = steps.get(text[start:end])
                if piece is None:
                    break
                if piece == NO_PIECE:  # the beginning of a piece only
                    continue
                single = single or end == start + 1
                self._add(edges[end], best, before, (start, piece, score[piece]), end)
            if not single:
                self._add(edges[start + 1], best, before, (start, -1 - ord(text[start]), self.unknown_score), start + 1)
        return best, edges

    @staticmethod
    def _add(at: list, best: list[float], before: float, edge: tuple[int, int, float], end: int) -> None:
        s = before + edge[2]
        if s > best[end] or (s == best[end] and edge[1] < at[0][1]):
            best[end] = s
            at.insert(0, edge)
        else:
            at.append(edge)

    def search(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths (score, lattice edges' ids) of one segment: forward Viterbi, then A*
        from the end."""
        best, edges = self.lattice(text)
        size = len(text)
        # heap: (minus the whole path's best score, ids from the end, place, score so far)
        heap: list[tuple[float, tuple[int, ...], int, float]] = [(-best[size], (), size, 0.0)]
        found: list[tuple[float, tuple[int, ...]]] = []
        popped = [0] * (size + 1)
        while heap and len(found) < n:
            _, tail, at, done = heapq.heappop(heap)
            if at == 0:
                found.append((done, tail[::-1]))
                continue
            popped[at] += 1
            if popped[at] > n:  # n better tails of this place are known: no later one can be needed
                continue
            for start, piece, s in edges[at]:
                heapq.heappush(heap, (-(best[start] + s + done), (*tail, piece), start, s + done))
        return found

    def learn(self, split: list[list[str]]) -> np.ndarray:
        """The rows of the segments of texts, one after the other; segments that are not known yet
        are walked, what was found before is remembered."""
        if self.learned.full():
            self.learned = self.learned.shrunk()
        known = self.learned
        before = len(known.rows)
        rows = np.fromiter(map(known.rows.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        known.again[rows[rows < before]] = True
        new, known.rows.new = known.rows.new, []
        known.chars += sum(map(len, new))
        for at in range(0, len(new), TOGETHER):
            known.add(*self.firsts(new[at : at + TOGETHER]))
        return rows

    def _looked_up(self, h: np.ndarray) -> np.ndarray:
        """Where each hash would be among the known ones; another one's place if it isn't."""
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        k, last = self.slot[slot], self.slot[slot + 1] - 1
        np.minimum(k, len(self.hashes) - 1, out=k)
        open_ = np.flatnonzero((k < last) & (self.hashes[k] < h))
        while len(open_):
            k[open_] += 1
            open_ = open_[(k[open_] < last[open_]) & (self.hashes[k[open_]] < h[open_])]
        return k

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of all pieces in segments that are laid out with a 0 after each."""
        inside = codes != 0
        starts, ends, ids = [], [], []
        at = np.flatnonzero(inside)
        h = np.zeros(len(at), np.uint64)
        single = ~inside
        n = 0
        while len(at):
            h = h * np.uint64(HASH) + codes[at + n] + np.uint64(1)
            n += 1
            spread = h * np.uint64(SPREAD)
            k = self._looked_up(spread)
            hit = self.hashes[k] == spread
            at, h, k = at[hit], h[hit], self.found[k[hit]]
            piece = k != NO_PIECE
            starts.append(at[piece])
            ends.append(at[piece] + n)
            ids.append(k[piece])
            if n == 1:
                single[at[piece]] = True
            go_on = inside[at + n]
            at, h = at[go_on], h[go_on]
        unknown = np.flatnonzero(~single)
        starts.append(unknown)
        ends.append(unknown + 1)
        ids.append(-1 - codes[unknown].astype(np.int64))
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)

    def firsts(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """The segments' best paths: score, what the second-best path costs more (the best one
        through any edge that the best path does not use, by the forward scores and the scores to the
        end), number of piece ids, the ids of all one after the other, and whether they decode to
        the segment. All segments are walked together, place by place."""
        text = "\0".join(segments) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        stops = np.flatnonzero(codes == 0)  # the place after each segment
        begins = np.concatenate(([0], stops[:-1] + 1))
        of = np.repeat(np.arange(len(segments)), stops - begins + 1)
        place = np.arange(len(codes)) - begins[of]
        start, end, ids = self._edges(codes)
        score = np.where(ids >= 0, self.scores[np.maximum(ids, 0)], self.unknown_score)

        best = np.full(len(codes), _NONE)
        best[begins] = 0.0
        back = np.zeros(len(codes), np.int64)
        if len(codes) < 1 << 20:  # one number for (place, end, id)
            order = np.argsort((place[end] << 42) + (end << 22) + (ids + (1 << 21)))
        else:
            order = np.lexsort((ids, end, place[end]))
        for group, ends_at in _steps(place[end][order], end[order]):
            edge = order[group]
            s = best[start[edge]] + score[edge]
            top = np.maximum.reduceat(s, ends_at)
            sizes = np.diff(np.append(ends_at, len(edge)))
            first = np.minimum.reduceat(np.where(s == np.repeat(top, sizes), np.arange(len(edge)), len(edge)), ends_at)
            best[end[edge[ends_at]]] = top
            back[end[edge[ends_at]]] = edge[first]  # of equal ones the smallest id

        after = np.full(len(codes), _NONE)
        after[stops] = 0.0
        order = np.argsort(start - place[start] * len(codes))
        for group, starts_at in _steps(-place[start][order], start[order]):
            edge = order[group]
            after[start[edge[starts_at]]] = np.maximum.reduceat(score[edge] + after[end[edge]], starts_at)

        used = np.zeros(len(ids), bool)
        at = stops
        while len(at):
            used[back[at]] = True
            at = start[back[at]]
            at = at[place[at] > 0]
        through = np.where(used, _NONE, best[start] + score + after[end])
        order = np.argsort(start)
        owner = of[start[order]]
        second = np.maximum.reduceat(through[order], np.flatnonzero(np.append(True, owner[1:] != owner[:-1])))
        path = order[used[order]]
        flat, owner = ids[path], of[start[path]]
        exact = np.ones(len(segments), bool)
        unknown = np.unique(owner[flat < 0])
        if len(unknown):  # their characters are written as bytes
            cuts = np.searchsorted(owner, np.arange(1, len(segments)))
            rows = np.split(flat, cuts)
            for k in unknown.tolist():
                rows[k] = np.array(self.ids(tuple(rows[k].tolist())), np.int64)
                exact[k] = self._shows(rows[k].tolist(), segments[k])
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.concatenate(rows)
        else:
            lengths = np.bincount(owner, minlength=len(segments))
        total = best[stops]
        return total, total - second, lengths, flat.astype(np.int32), exact

    def ids(self, path: tuple[int, ...]) -> tuple[int, ...]:
        """The piece ids of lattice edges: an unknown character is its bytes."""
        if not path or min(path) >= 0:
            return path
        out: list[int] = []
        for i in path:
            if i >= 0:
                out.append(i)
            else:
                data = chr(-1 - i).encode("utf-8", "replace")
                out += [self.byte_id.get(b, self.unknown) for b in data] if self.byte_id else [self.unknown]
        return tuple(out)

    def split(self, text: str | None) -> list[str]:
        """The segments of a text's lattice."""
        return self.segments.findall(self.normalise((text or "").replace("\0", "\ufffd")))

    def nbest(self, text: str | None, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best (score, piece ids) of a text, best first."""
        segments = self.split(text)
        return [(score, ids) for score, ids, _ in self.combined(segments, self.learn([segments]), n)]

    def paths(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...], bool]]:
        """The n best (score, piece ids, whether they decode to it) of one segment; short ones are
        remembered."""
        found = self.searched.get((segment, n))
        if found is None:
            each = [(s, self.ids(path)) for s, path in self.search(segment, n)]
            found = [(s, ids, self._shows(ids, segment)) for s, ids in each]
            if len(self.searched) >= SEARCHED:
                self.searched.clear()
            if len(segment) <= LONG:
                self.searched[segment, n] = found
        return found

    def combined(self, segments: list[str], rows: np.ndarray, n: int) -> list[tuple[float, np.ndarray, bool]]:
        """The n best (score, piece ids, whether every segment's ids decode to it) of a text from
        its segments' learned rows."""
        known = self.learned
        base = sum(known.score[rows].tolist())
        best, exact = known.paths(rows), known.exact[rows]
        sound = bool(exact.all())
        if n == 1 or not segments:
            return [(base, best, sound)]
        cost = known.cost[rows]
        limit = np.partition(cost, n - 2)[n - 2] if len(cost) >= n else np.inf
        cheap = sorted((cost[k], k) for k in np.flatnonzero(cost <= limit).tolist() if cost[k] < np.inf)[: n - 1]
        chosen = sorted(k for _, k in cheap)  # by place
        options = [self.paths(segments[k], n) for k in chosen]
        # search backward over the chosen segments; the others keep their best path
        heap: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]  # cost so far, ranks from the last segment
        found: list[tuple[float, tuple[int, ...]]] = []
        while heap and len(found) < n:
            paid, ranks = heapq.heappop(heap)
            if len(ranks) == len(chosen):
                found.append((paid, ranks))
                continue
            o = options[len(chosen) - 1 - len(ranks)]
            for r in range(len(o)):
                heapq.heappush(heap, (paid + o[0][0] - o[r][0], (*ranks, r)))
        lengths = known.length[rows]
        starts = np.cumsum(lengths) - lengths
        out = []
        for paid, ranks in found:
            parts, at, right = [], 0, sound
            for k, o, r in zip(chosen, options, ranks[::-1], strict=True):
                if r:
                    parts += [best[at : starts[k]], np.array(o[r][1], np.int32)]
                    at = starts[k] + lengths[k]
                    right = right and o[r][2]
            out.append((base - paid, np.concatenate([*parts, best[at:]]) if parts else best, right))
        return out

    def _shows(self, ids, segment: str) -> bool:
        """Whether the ids decode to a segment (of whole characters, so its bytes stand alone)."""
        return self._written(ids) == segment.replace(SPACE, " ")

    def round_trips(self, text: str | None, segments: list[str], found: list[tuple[float, np.ndarray, bool]]) -> list[bool]:
        """Whether each path's ids decode to the text. Where every segment's ids decode to the
        segment, the whole decodes to the segments one after the other; else it is decoded."""
        joined = "".join(segments).replace(SPACE, " ")
        same = (joined[1:] if joined.startswith(" ") else joined) == (text or "")
        return [same if sound else self.decode(ids) == (text or "") for _, ids, sound in found]

    def decode(self, ids) -> str:
        """The text of piece ids: bytes joined, control pieces left out, marks as spaces."""
        joined = self._written(ids)
        return joined[1:] if joined.startswith(" ") else joined

    def _written(self, ids) -> str:
        if isinstance(ids, np.ndarray) and not self.part_of_character[ids].any():
            return "".join(self.shown[ids].tolist())
        words: list[str] = []
        pending = b""
        hidden, byte_of, text = self.hidden, self.byte_of, self.text
        for i in ids.tolist() if isinstance(ids, np.ndarray) else ids:
            if i in byte_of:
                pending += byte_of[i]
                continue
            if pending:
                words.append(pending.decode("utf-8", "replace"))
                pending = b""
            if i not in hidden:
                words.append(text[i])
        if pending:
            words.append(pending.decode("utf-8", "replace"))
        return "".join(words).replace(SPACE, " ")


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def read_model(path: str = MODEL) -> bytes:
    """The model's bytes, read by the driver and sent with the tasks (half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def nbest_encode(
    docs: DataFrame, n: int = 3, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document and path: id, rank (from 1), score, n_pieces, ids, round_trip
    (whether the ids decode to the text)."""
    model = model or read_model()
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        try:
            for batch in batches:
                for part in _parts(batch):
                    split = [pieces.split(text) for _, text in part]
                    rows = pieces.learn(split)
                    keys, ranks, scores, paths, right, at = [], [], [], [], [], 0
                    for (key, text), segments in zip(part, split, strict=True):
                        found = pieces.combined(segments, rows[at : at + len(segments)], n)
                        at += len(segments)
                        keys += [key] * len(found)
                        ranks += range(1, len(found) + 1)
                        scores += [score for score, _, _ in found]
                        paths += [ids for _, ids, _ in found]
                        right += pieces.round_trips(text, segments, found)
                    yield _batch(keys, ranks, scores, paths, right)
        finally:
            pieces.forget()  # the process goes on to other tasks

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    schema = "id string, rank int, score double, n_pieces long, ids array<int>, round_trip boolean"
    return rows.mapInArrow(run, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def _batch(keys: list, ranks: list, scores: list, paths: list, right: list) -> pa.RecordBatch:
    sizes = np.fromiter(map(len, paths), np.int64, len(paths))
    flat = np.concatenate(paths) if paths else np.empty(0, np.int32)
    ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat, pa.int32()))
    columns = {
        "id": pa.array(keys, pa.string()),
        "rank": pa.array(ranks, pa.int32()),
        "score": pa.array(scores, pa.float64()),
        "n_pieces": pa.array(sizes, pa.int64()),
        "ids": ids,
        "round_trip": pa.array(right, pa.bool_()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _parts(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Rows (id, text) of a batch, half a million characters at a time (or one text)."""
    part, size = [], 0
    for key, text in zip(batch.column("id"), batch.column("text"), strict=True):
        key, text = key.as_py(), text.as_py()
        part.append((key, text))
        size += len(text or "")
        if size > 1 << 19:
            yield part
            part, size = [], 0
    yield part


def _steps(keys: np.ndarray, groups: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The runs of equal sorted ``keys`` as slices, each with where its runs of ``groups`` begin."""
    cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else [0]
    new = np.append(True, groups[1:] != groups[:-1]) if len(keys) else np.empty(0, bool)
    for a, b in pairwise(cuts):
        begin = new[a:b].copy()
        begin[0] = True
        yield slice(a, b), np.flatnonzero(begin)


def decode(ids: Column, model: bytes | None = None) -> Column:
    """The texts of an array<int> column of piece ids (null: null)."""
    model = model or read_model()

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        pieces = _pieces(model)
        return rows.map(lambda x: None if x is None else pieces.decode(x))

    return run(ids)
