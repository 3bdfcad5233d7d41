"""Byte-level BPE: ids of texts by a file of ranks, with the offset of each token, and back.

Texts are cut as public_tokenizers.PATTERN cuts them, but without a regular expression. Each code point
gets a symbol from a table of classes (letter, number, white space, other; by the edition of Unicode that
the tiktoken library has, where it is installed), refined by at most two code
points ahead: a space before other than white space, an apostrophe before the letters of a short form.
Over these symbols the pattern is an automaton of eight states. Its transition functions form a small
monoid, so the state before each code point is an associative scan: functions of chunks are composed by
table lookups for all chunks at once, chunks are scanned the same way, and the states within chunks
follow. The slices between starts of matches are merged by rank, each distinct slice once, from a
bounded cache.

`encode` gives, per row, token_ids and offsets, the byte of the text (UTF-8) where each token starts;
`decode` puts the bytes of the ids at these offsets. No shuffle; rows are independent. Memory is bounded
by a slice of about a megabyte, cut at a space before which a match always ends, or by a longer stretch
without such a space, and by the ids of one text.

Defined results: a null or empty text has no tokens; repeated rows have theirs each. Ids keep their
column's type and value; other columns are not read. Where a row's ids are null or hold one without
bytes, its decoded value is null.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from meterlake.llm.tasks import in_small_batches, parts

#: Symbols of the automaton. JOIN: a space before other than white space; ALONE: other white space there;
#: BLANK: white space before more of it, or at the end; SHORT, LONGER: an apostrophe before one or two letters of a short form.
LETTER, NUMBER, OTHER, JOIN, ALONE, BLANK, SHORT, LONGER, END, NOTHING = range(10)
#: States: what the match is that the last code point belongs to.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, JOINED, ONE_LEFT, TWO_LEFT = range(8)
#: The letters of short forms, the pattern, and white space.
SHORT_FORMS, LONGER_FORMS = "stmd", ("re", "ve", "ll")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def follow(state: int, symbol: int) -> tuple[int, bool]:
    """The state after the symbol, and whether a match starts at it."""
    if symbol == NOTHING:
        return state, False
    if symbol == LETTER and state in (ONE_LEFT, TWO_LEFT):
        return FRESH if state == ONE_LEFT else ONE_LEFT, False
    if symbol in (SHORT, LONGER) and state not in (IN_OTHERS, JOINED):
        return ONE_LEFT if symbol == SHORT else TWO_LEFT, True
    if symbol in (JOIN, ALONE, END):
        return JOINED if symbol == JOIN else FRESH, True
    own = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, BLANK: IN_BLANKS}.get(symbol, IN_OTHERS)
    return own, not (state == own or state == JOINED and symbol != BLANK)


class Automaton:
    """The transition functions of all sequences of symbols, numbered, with their products."""

    def __init__(self):
        self.after = np.array([[follow(s, c)[0] for c in range(10)] for s in range(8)], np.uint8)
        self.starts = np.array([[follow(s, c)[1] for c in range(10)] for s in range(8)])
        functions = [tuple(int(x) for x in self.after[:, c]) for c in range(10)]
        known = {f: i for i, f in reversed(list(enumerate(functions)))}
        every = list(functions)
        for f in every:  # grows while it is read
            for c in range(10):
                g = tuple(functions[c][s] for s in f)
                if g not in known:
                    known[g] = len(every)
                    every.append(g)
        self.result = np.array(every, np.uint8)
        self.product = np.array([[known[tuple(g[s] for s in f)] for g in every] for f in every], np.uint16)

    def fold(self, table: np.ndarray) -> np.ndarray:
        """The product of the functions of each column of a (steps, chunks) table."""
        done = table[0]
        for row in table[1:]:
            done = self.product[done, row]
        return done

    def states_before(self, symbols: np.ndarray, first: int = FRESH, chunk: int = 128) -> np.ndarray:
        """The state before each symbol (or each numbered function), from a first state on."""
        n = len(symbols)
        if n <= chunk:
            out = np.empty(n, np.uint8)
            for i, f in enumerate(symbols.tolist()):
                out[i] = first
                first = self.result[f, first]
            return out
        table = np.full(-(-n // chunk) * chunk, NOTHING, np.uint16)
        table[:n] = symbols
        table = np.ascontiguousarray(table.reshape(-1, chunk).T)
        state = self.states_before(self.fold(table), first, chunk)
        out = np.empty(table.shape, np.uint8)
        for row, functions in zip(out, table, strict=True):
            row[:] = state
            state = self.result[functions, state]
        return np.ascontiguousarray(out.T).reshape(-1)[:n]


@cache
def automaton() -> Automaton:
    return Automaton()


@cache
def classes() -> np.ndarray:
    """Per code point LETTER, NUMBER, OTHER or BLANK, by this Python's edition of Unicode."""
    kinds = {"L": LETTER, "N": NUMBER}
    found = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    found[[ord(c) for c in WHITE]] = BLANK
    return found


@cache
def library_classes() -> bytes:
    """The same table by the edition of Unicode that the tiktoken library has, where it is installed.

    Editions differ in code points that the older one lacks; those below 0x40000 are asked for. A vocabulary whose only pairs are any byte and "a" joins the end of a code point with an "a" after
    it just where both are in one match, so where the code point is a letter; with "1" likewise.
    """
    found = classes().copy()
    try:
        import tiktoken
    except ImportError:
        return found.tobytes()
    asked = np.array([c for c in range(0x40000) if unicodedata.category(chr(c)) == "Cn"])
    for tail, kind in (("a", LETTER), ("1", NUMBER)):
        pairs = {bytes([b]) + tail.encode(): 256 + b for b in range(256)}
        probe = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks={bytes([b]): b for b in range(256)} | pairs, special_tokens={})
        ids = np.array(probe.encode_ordinary("".join(chr(c) + tail + "\n" for c in asked)))
        last = ids[np.flatnonzero(ids == 10) - 1]
        found[asked[last >= 256]] = kind
    return found.tobytes()


def match_starts(codes: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """True where a match starts. codes: code points of texts, each followed by any one more, whose places are ends."""
    symbols = table[codes]
    symbols[ends] = END
    blank = symbols == BLANK
    ahead = np.append(~blank[1:] & (symbols[1:] != END), False)
    symbols[blank & ahead] = np.where(codes[blank & ahead] == 32, JOIN, ALONE)
    marks = np.flatnonzero((codes == ord("'")) & (symbols == OTHER))
    if len(marks):
        inside = np.append(np.where(symbols == END, 0, codes), [0, 0])
        one, two = inside[marks + 1], inside[marks + 2]
        symbols[marks[np.isin(one, [ord(c) for c in SHORT_FORMS])]] = SHORT
        for a, b in LONGER_FORMS:
            symbols[marks[(one == ord(a)) & (two == ord(b))]] = LONGER
    return automaton().starts[automaton().states_before(symbols), symbols]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the pair of lowest rank, the leftmost of equals, is joined as long as there is one."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, left = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j = heapq.heappop(heap)
        mid = end[i]
        if not 0 < mid < n or end[mid] != j:
            continue
        end[i], end[mid], left[j] = j, 0, i
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))
        if i and (r := ranks.get(piece[left[i] : j])) is not None:
            heapq.heappush(heap, (r, left[i], j))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Pairs:
    """The ids of all pairs of tokens that make a token, for joining in many pieces at once."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, ranks: dict[bytes, int]):
        joined = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, made = np.array(joined, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], self.NONE), np.append(made[order], self.NONE)
        self.single = np.array([ranks[bytes([b])] for b in range(256)])

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Per pair the id of its token, NONE where there is none or a side is missing (-1)."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], self.NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """What the function `merge` gives for pieces that are no tokens, as little-endian int32; all of about one length."""
        width = max(map(len, pieces)) + 1
        ids = np.full((len(pieces), width), -1)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        pairs = np.column_stack([self.join(ids[:, :-1], ids[:, 1:]), np.full(len(ids), self.NONE)])
        done, rows = [b""] * len(pieces), np.arange(len(pieces))
        while len(rows):
            at = pairs.argmin(1)
            best = pairs[np.arange(len(rows)), at]
            ready = best == self.NONE
            for row, n, own in zip(rows[ready].tolist(), (ids[ready] >= 0).sum(1).tolist(), ids[ready].astype("<i4"), strict=True):
                done[row] = own[:n].tobytes()
            rows, ids, pairs, at, best = (x[~ready] for x in (rows, ids, pairs, at, best))
            if not len(rows):
                break
            line, width = np.arange(len(rows)), ids.shape[1] - 1
            ids[line, at] = best
            keep = np.arange(width) + (np.arange(width) > at[:, None])
            ids = np.take_along_axis(ids, keep, 1)
            pairs = np.take_along_axis(pairs, keep, 1)
            pairs[line, at] = np.where(at + 1 < width, self.join(best, ids[line, np.minimum(at + 1, width - 1)]), self.NONE)
            before = np.flatnonzero(at)
            pairs[before, at[before] - 1] = self.join(ids[before, at[before] - 1], best[before])
        return done


def slices(texts: list[str], size: int = 1 << 20):
    """Lists of (number of the text, part of it), about `size` characters each; parts end before a space where a match ends."""
    held, total = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            to = len(text)
            if to - at > size and (space := re.compile(r"\S(?= \S)").search(text, at + size - 1)):
                to = space.end()
            if held and total + to - at > size:
                yield held
                held, total = [], 0
            held.append((i, text[at:to]))
            total += to - at
            at = to
            if not text:
                break
    if held:
        yield held


class ByteBpe:
    """A vocabulary: lines of a token's bytes in base 64 and its rank, which is its id. Every single byte is a token."""

    def __init__(self, lines: bytes, table: bytes | None = None, max_pieces: int = 300_000):
        self.table = classes() if table is None else np.frombuffer(table, np.uint8)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line.strip())}
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.pairs = Pairs(self.ranks)
        self.max_pieces = max_pieces
        self.pieces: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def find(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each, little-endian int32; the cache holds the pieces used last, about twice max_pieces at most."""
        found = [self.pieces.get(p) for p in pieces]
        missing: dict[int, list[int]] = {}
        for i, (piece, ids) in enumerate(zip(pieces, found, strict=True)):
            if ids is None:
                ids = self.older.get(piece)
                if ids is None and piece in self.ranks:
                    ids = self.ranks[piece].to_bytes(4, "little")
                if ids is None and len(piece) > 64:
                    ids = np.array(merge(piece, self.ranks), "<i4").tobytes()
                if ids is None:
                    missing.setdefault(-(-len(piece) // 4), []).append(i)
                else:
                    found[i] = ids
                    if len(piece) <= 256:
                        self.pieces[piece] = ids
        for some in missing.values():
            for lo in range(0, len(some), 1 << 15):
                part = some[lo : lo + (1 << 15)]
                for i, ids in zip(part, self.pairs.merge([pieces[i] for i in part]), strict=True):
                    found[i] = self.pieces[pieces[i]] = ids
        if len(self.pieces) >= self.max_pieces:
            self.older, self.pieces = self.pieces, {}
        return found

    def encode_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of them per text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(sizes) - 1
        raw = "\n".join([*texts, ""]) if texts else ""
        codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = match_starts(codes, ends, self.table)
        inside = np.ones(len(codes), bool)
        inside[ends] = starts[ends] = False
        wide = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.cumsum(np.where(inside, wide, 0), dtype=np.int64)
        first = np.flatnonzero(starts)
        data = "".join(texts).encode("utf-8", "surrogatepass")
        offsets = np.append(place[first] - wide[first], len(data)).astype(np.int32)
        distinct = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        held = self.find(distinct.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(held), "<i4")
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        at = distinct.indices.to_numpy()
        n = sizes[at]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[at] - before[:-1], n) + np.arange(before[-1])]
        bounds = before[np.searchsorted(first, np.concatenate([[0], ends]))]
        return ids, np.diff(bounds)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte offsets of all texts in a row, and the number of them per text."""
        counts = np.zeros(len(texts), np.int64)
        found = []
        for part in slices([t or "" for t in texts]):
            ids, n = self.encode_parts([t for _, t in part])
            np.add.at(counts, [i for i, _ in part], n)
            found.append(ids)
        ids = np.concatenate([np.zeros(0, np.int32), *found])
        end = np.cumsum(self.lengths[ids])
        before = np.concatenate([[0], end])[np.cumsum(counts) - counts]
        return ids, end - self.lengths[ids] - np.repeat(before, counts), counts

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes | None:
        """The bytes of the ids, each at its offset."""
        if len(ids) == 0:
            return b""
        if ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all():
            return None
        n = self.lengths[ids]
        ends = np.cumsum(n)
        step = np.arange(ends[-1])
        out = np.zeros(int((offsets + n).max()), np.uint8)
        out[np.repeat(offsets - ends + n, n) + step] = self.flat[np.repeat(self.at[ids] - ends + n, n) + step]
        return out.tobytes()


_vocabularies: dict[bytes, ByteBpe] = {}


def _vocabulary(shared) -> ByteBpe:
    """One per worker process and file."""
    lines, table = shared.value
    if lines not in _vocabularies:
        _vocabularies[lines] = ByteBpe(lines, table)
    return _vocabularies[lines]


def _shared(df: DataFrame, path: str):
    """The file of ranks and the table of classes, sent to the workers: a vocabulary, and a byte for each code point."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), library_classes()))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, token_ids array<int>, offsets array<bigint>; ranks_path is read by the driver."""
    shared = _shared(docs, ranks_path)

    def run(batches):
        vocabulary = _vocabulary(shared)
        for batch in parts(batches):
            ids, offsets, counts = vocabulary.encode(batch["text"].to_pylist())
            bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (ids, offsets)]
            yield pa.RecordBatch.from_arrays([batch["id"], *lists], names=[id_col, "token_ids", "offsets"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, token_ids array<int>, offsets array<bigint>")


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "token_ids", offsets_col: str = "offsets") -> DataFrame:
    """id, token_ids and decoded binary: the bytes of the ids at their offsets. Without offsets, one after another."""
    shared = _shared(tokens, ranks_path)

    def run(batches):
        vocabulary = _vocabulary(shared)
        for batch in parts(batches):
            ids, offsets = pc.list_flatten(batch["ids"]).to_numpy(zero_copy_only=False), pc.list_flatten(batch["offsets"]).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(batch["ids"]), 0).to_numpy()
            known = batch["ids"].is_valid().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            made = [vocabulary.decode(ids[a:b], offsets[a:b]) if good else None for a, b, good in zip(bounds[:-1], bounds[1:], known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["ids"], pa.array(made, pa.binary())], names=[id_col, ids_col, "decoded"])

    kind = tokens.schema[id_col].dataType.simpleString()
    whole = ~F.exists(ids_col, lambda x: x.isNull())
    rows = tokens.select(F.col(id_col).alias("id"), F.when(whole, F.col(ids_col).cast("array<int>")).alias("ids"), F.when(whole, F.col(offsets_col).cast("array<bigint>")).alias("offsets"))
    return in_small_batches(rows).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded binary")
