"""Words of many texts as numpy arrays, for use inside Arrow batches.

Texts are handled in blocks of bounded size. Each block becomes one byte array whose words get
64-bit hashes by prefix sums, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

#: Bytes of text that one numpy block holds at most, but for a single longer text.
BLOCK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)
_GRAM_INV = np.uint64(pow(int(_GRAM), -1, 1 << 64))


def _table(is_word) -> bytes:
    return bytes((b + 32 if 65 <= b <= 90 else b) if is_word(b) else 32 for b in range(256))


#: Lower-cases A-Z; words are runs of 0-9, a-z and bytes of characters beyond ASCII.
ALNUM = _table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Lower-cases A-Z; words are runs of anything but space and tab to carriage return.
SPACED = _table(lambda b: b != 32 and not 9 <= b <= 13)


def encode(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def words_of(text: str | None, table: bytes = ALNUM) -> list[bytes]:
    """The words of one text."""
    return encode(text).translate(table).split()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * BLOCK_BYTES), base, np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.cumprod(have)
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


class Block(NamedTuple):
    """Words of some texts: hash, place in bytes, and where each text's words lie."""

    first: int  # number of the first text
    hashes: np.ndarray  # uint64 per word
    starts: np.ndarray  # byte offset in data per word
    ends: np.ndarray
    bounds: np.ndarray  # text i has words bounds[i] .. bounds[i + 1]
    text_starts: np.ndarray  # byte offset of each text in data
    data: np.ndarray  # bytes as given, uint8


def _block(first: int, texts: list[bytes], table: bytes) -> Block:
    raw = b"\n".join(texts)
    low = np.frombuffer(raw.translate(table), np.uint8)
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = low != 32
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = prefix((low.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(low)))
    hashes = mix((sums[ends] - sums[starts]) * powers(_BASE_INV, len(low) + 1)[starts])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    bounds = np.searchsorted(starts, text_starts[:-1], "left")
    return Block(first, hashes, starts, ends, np.append(bounds, len(starts)), text_starts[:-1], np.frombuffer(raw, np.uint8))


def blocks(texts: Iterable[str | None], table: bytes) -> Iterator[Block]:
    held: list[bytes] = []
    size = first = 0
    for text in texts:
        data = encode(text)
        if held and size + len(data) > BLOCK_BYTES:
            yield _block(first, held, table)
            first, held, size = first + len(held), [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield _block(first, held, table)


def counts(texts: Iterable[str | None], table: bytes) -> Iterator[int]:
    """Number of words of each text."""
    for b in blocks(texts, table):
        yield from np.diff(b.bounds).tolist()


def left_in_text(bounds: np.ndarray) -> np.ndarray:
    """Per word, how many words of its text there are from it on."""
    return np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[-1])


def grams(hashes: np.ndarray, k: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Hash of each run of k words, one per start in the block (also over text borders; mask with left_in_text)."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    sums = gram_sums(hashes) if sums is None else sums
    n = len(hashes) - k + 1
    return mix((sums[k:] - sums[:n]) * powers(_GRAM_INV, n))


def gram_sums(hashes: np.ndarray) -> np.ndarray:
    return prefix(hashes * powers(_GRAM, len(hashes)))


def slide(values: np.ndarray, w: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each window of w values, by doubling."""
    span = 1
    while span * 2 <= w:
        values = op(values[:-span], values[span:])
        span *= 2
    if span < w:
        values = op(values[: len(values) - (w - span)], values[w - span :])
    return values


def winnow(hashes: np.ndarray, left: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the k-grams that are smallest in some window of w k-grams of one text.

    Any k + w - 1 words that two texts share give both the same selected k-gram. All of equal
    smallest hashes in a window are selected.
    """
    g = grams(hashes, k)
    if len(g) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = slide(g, w, np.minimum)
    whole = left[: len(low)] >= k + w - 1
    top = np.zeros(len(g) + w - 1, np.uint64)
    top[w - 1 : w - 1 + len(low)] = np.where(whole, low, np.uint64(0))
    reach = np.zeros(len(g) + w - 1, bool)
    reach[w - 1 : w - 1 + len(low)] = whole
    some = prefix(reach.astype(np.uint64))
    picked = (slide(top, w, np.maximum) == g) & (some[w:] > some[:-w])
    at = np.flatnonzero(picked)
    return at, g[at]
