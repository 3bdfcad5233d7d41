"""Periodic runs of words, by a run-length grammar made by recompression.

A run is a stretch of consecutive words with a smallest period q, at least `powers` * q and at least
`least` words long, that no neighbouring word extends keeping the period.

The words of some texts become one sequence of numbers, with a mark of its own before and after each
text. Rounds of recompression make a grammar of it: block compression replaces each stretch of one
repeated symbol by a symbol for (symbol, length), then pair compression replaces each neighbouring pair
whose first symbol is in one half of the alphabet and whose second is in the other. What is replaced
depends on the symbols alone, so equal stretches are cut equally but for their ends. A longest common
extension of two places is then found by going up while symbols are equal, with at most one step of
whole symbols (or of a whole number of repeated ones) a level, and down again where they differ. All
extensions, to the right and to the left, go through the levels together, and a level is made only if
some extension is still equal below it.

Candidates lie on harmonic grids: a run of period q holds a place p, a multiple of (powers - 1) * q, with
word p = word p + q. Over all q these are about n ln n / (powers - 1) places; those where two words a
period apart are equal twice in a row are extended. A stretch that is found with several periods has the
smallest.

No shuffle; rows are independent. Memory is bounded by a slice of texts of about a megabyte, or by one
longer text, and by slices of its candidates.

Defined results: null and empty texts have no words and no runs. Repeated rows have their runs each; null
ids are kept. Other columns are not read. Words are compared as they are, with upper and lower case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlake.llm.tasks import in_small_batches, parts, parts_of_size
from meterlake.llm.words import encode, mix

#: White space becomes a space, all else stays.
BLANKS = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
#: Places of a slice of candidates.
SLICE = 1 << 20


class Level:
    """A sequence of the grammar, with the number of words that each symbol stands for."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, names: int):
        self.symbols, self.sizes, self.names = symbols, sizes, names

    def _group(self, first: np.ndarray, repeats: bool) -> None:
        """Groups of the next level start where first is true."""
        self.repeats = repeats
        self.group = np.cumsum(first) - 1
        self.first = np.append(np.flatnonzero(first), len(first))

    def blocks(self) -> Level:
        """Block compression; the level itself becomes the lower one of the two."""
        changed = np.ones(len(self.symbols), bool)
        changed[1:] = self.symbols[1:] != self.symbols[:-1]
        self._group(changed, True)
        n = np.diff(self.first)
        made = self.symbols[self.first[:-1]].copy()
        many = np.flatnonzero(n > 1)
        _, own = np.unique(np.column_stack([made[many], n[many]]), axis=0, return_inverse=True)
        made[many] = self.names + own.reshape(-1)
        return Level(made, self.sizes[self.first[:-1]] * n, self.names + len(many))

    def pairs(self, seeds: range) -> Level:
        """Pair compression, by the seed of those given that joins most."""
        best = None
        for seed in seeds:
            half = mix(self.symbols.astype(np.uint64) + np.uint64(seed << 40)) & np.uint64(1) == 1
            joined = ~half[:-1] & half[1:]
            if best is None or joined.sum() > best.sum():
                best = joined
        first = np.ones(len(self.symbols), bool)
        first[1:] = ~best
        self._group(first, False)
        at = np.flatnonzero(best)
        made = self.symbols[self.first[:-1]].copy()
        _, own = np.unique(self.symbols[at] * self.names + self.symbols[at + 1], return_inverse=True)
        made[self.group[at]] = self.names + own
        return Level(made, np.add.reduceat(self.sizes, self.first[:-1]), self.names + len(at))

    def equal(self, a: np.ndarray, b: np.ndarray, back: np.ndarray) -> np.ndarray:
        return self.symbols[a - back] == self.symbols[b - back]

    def step(self, a: np.ndarray, b: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both moved over the equal symbols beside them that lie in one group each, and the words passed."""
        n = np.ones(len(a), np.int64)
        if self.repeats:
            for x in (a, b):
                own = self.group[x - back]
                left = np.where(back == 1, x - self.first[own], self.first[own + 1] - x)
                n = left if x is a else np.minimum(n, left)
        way = n * (1 - 2 * back)
        return a + way, b + way, n * self.sizes[a - back]

    def at_border(self, x: np.ndarray) -> np.ndarray:
        return self.first[self.group[x]] == x


class Grammar:
    """Levels above a sequence in which no extension meets an end: marks that stand once lie beside each text."""

    def __init__(self, symbols: np.ndarray):
        self.levels = [Level(symbols, np.ones(len(symbols), np.int64), int(symbols.max(initial=0)) + 1)]

    def _above(self, k: int) -> None:
        if k + 1 == len(self.levels):
            low = self.levels[k]
            made = low.blocks() if k % 2 == 0 else low.pairs(range(4 * k, 4 * k + 4))
            # names are made dense, so that products of two stay within 64 bits
            found, made.symbols = np.unique(made.symbols, return_inverse=True)
            made.names = len(found)
            self.levels.append(made)

    def extend(self, a: np.ndarray, b: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Per pair of different places how many words are equal from them on; with back = 1, before them."""
        words = np.zeros(len(a), np.int64)
        stopped = []
        active, k = np.arange(len(a)), 0
        while len(active):
            level = self.levels[k]
            same = level.equal(a, b, back)
            stopped.append((active[~same], a[~same], b[~same], back[~same]))
            active, a, b, back = active[same], a[same], b[same], back[same]
            if not len(active):
                break
            self._above(k)
            inside = np.flatnonzero(~(level.at_border(a) & level.at_border(b)))
            if len(inside):
                a, b = a.copy(), b.copy()
                a[inside], b[inside], n = level.step(a[inside], b[inside], back[inside])
                words[active[inside]] += n
                uneven = ~(level.at_border(a) & level.at_border(b))
                rest = (active[uneven], a[uneven], b[uneven], back[uneven])
                stopped[-1] = tuple(np.concatenate(x) for x in zip(stopped[-1], rest, strict=True))
                active, a, b, back = active[~uneven], a[~uneven], b[~uneven], back[~uneven]
            a, b, k = level.group[a], level.group[b], k + 1
        held = tuple(np.zeros(0, np.int64) for _ in range(4))
        for k in range(len(stopped) - 1, -1, -1):
            # places that differ at the level above: their groups begin here, and may share one step
            if len(held[0]):
                level = self.levels[k]
                active, a, b, back = held[0], level.first[held[1]], level.first[held[2]], held[3]
                same = np.flatnonzero(level.equal(a, b, back))
                a[same], b[same], n = level.step(a[same], b[same], back[same])
                words[active[same]] += n
                held = (active, a, b, back)
            held = tuple(np.concatenate(x) for x in zip(held, stopped[k], strict=True))
        return words


def candidates(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, powers: int):
    """Slices of (text, place, period) on the grids, where words a period apart are equal twice in a row."""
    top = sizes // powers
    text = np.repeat(np.arange(len(sizes)), top)
    period = np.arange(len(text)) - np.repeat(np.cumsum(top) - top, top) + 1
    n = (sizes[text] - period - 1) // ((powers - 1) * period) + 1
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE, "right")))
        own, q = np.repeat(text[lo:hi], n[lo:hi]), np.repeat(period[lo:hi], n[lo:hi])
        step = np.arange(len(own)) - np.repeat(ends[lo:hi] - n[lo:hi] - base, n[lo:hi])
        p = starts[own] + step * (powers - 1) * q
        good = np.flatnonzero(symbols[p] == symbols[p + q])
        own, q, p = own[good], q[good], p[good]
        after, before = np.minimum(p + 2 * q, len(symbols) - 1), np.maximum(p - q, 0)
        good = np.flatnonzero((symbols[p] == symbols[after]) | (symbols[before] == symbols[p]))
        yield own[good], p[good], q[good]
        lo = hi


def runs(words: list[np.ndarray], powers: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, in the order of text, start, period. words: whole numbers from 0 per text."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    texts = np.flatnonzero(sizes >= max(powers, least))
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(texts) or powers < 3:
        if powers < 3:
            raise ValueError("grids are made for runs of at least three periods")
        return none
    sizes = sizes[texts]
    mark = 1 + max(int(words[i].max()) for i in texts)
    symbols = np.concatenate([x for k, i in enumerate(texts) for x in ([mark + k], words[i])] + [[mark + len(texts)]]).astype(np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    _, symbols = np.unique(symbols, return_inverse=True)
    found = []
    grammar = None
    for text, p, q in candidates(symbols, starts, sizes, powers):
        if not len(p):
            continue
        grammar = grammar or Grammar(symbols)
        n = len(p)
        right, left = grammar.extend(np.tile(p, 2), np.tile(p + q, 2), np.repeat([0, 1], n)).reshape(2, n)
        length = right + left + q
        good = length >= np.maximum(powers * q, least)
        found.append(np.column_stack([text, p - left - starts[text], length, q])[good])
    if not found:
        return none
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return texts[rows[:, 0]], rows[:, 1], rows[:, 2], rows[:, 3]


def split_words(texts: list[str | None]) -> tuple[list[np.ndarray], bytes, np.ndarray, np.ndarray]:
    """Per text its words as numbers; then the words of all in a row, a space after each, where each starts, and each text's bounds among them."""
    raw = b" ".join([*map(encode, texts), b""])
    low = np.frombuffer(raw.translate(BLANKS), np.uint8)
    inside = low != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    data = low[kept]
    at = (np.cumsum(kept) - 1)[first]
    offsets = np.append(at, len(data)).astype(np.int32)
    numbers = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy().astype(np.int64)
    ends = np.cumsum(np.fromiter((len(encode(t)) + 1 for t in texts), np.int64, len(texts)))
    bounds = np.searchsorted(np.flatnonzero(first), np.concatenate([[0], ends]))
    return np.split(numbers, bounds[1:-1]) if len(texts) else [], data.tobytes(), offsets, bounds


def search(texts: list[str | None], powers: int, least: int) -> tuple[list[int], list[list[dict]], list[bytes]]:
    """Per text the number of words, its runs, and the words but those in a run after its first period."""
    words, data, offsets, bounds = split_words(texts)
    text, start, length, period = runs(words, powers, least)
    found: list[list[dict]] = [[] for _ in texts]
    for i, s, n, q in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        found[i].append({"start": s, "length": n, "period": q})
    kept = []
    for i, own in enumerate(found):
        lo, hi = int(bounds[i]), int(bounds[i + 1])
        if not own:
            kept.append(data[offsets[lo] : offsets[hi] - 1] if hi > lo else b"")
            continue
        covered = np.zeros(hi - lo + 1, np.int64)
        np.add.at(covered, [r["start"] + r["period"] for r in own], 1)
        np.add.at(covered, [r["start"] + r["length"] for r in own], -1)
        left = np.concatenate([[False], np.cumsum(covered)[:-1] == 0, [False]])
        edges = np.flatnonzero(left[1:] != left[:-1]).reshape(-1, 2) + lo
        kept.append(b"".join(data[offsets[a] : offsets[b]] for a, b in edges.tolist())[:-1])
    return [len(w) for w in words], found, kept


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", powers: int = 4, least: int = 6) -> DataFrame:
    """id, n_words, runs array<struct<start, length, period>> by start and period, collapsed: the words without repeats, one space between."""

    def run(batches):
        for batch in parts(batches):
            for some in parts_of_size(batch, "text", 1 << 20):
                n, found, kept = search(some["text"].to_pylist(), powers, least)
                yield pa.RecordBatch.from_arrays([some["id"], pa.array(n, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
