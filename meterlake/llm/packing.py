"""Cost-balanced packing of token sequences.

Documents become token ids, with an end id. Each task packs its own rows in chunks of about
`chunk_tokens` tokens. A chunk of T tokens gets floor(T / capacity) full sequences, and for the
rest one short sequence for each power of two in it, so that nothing needs padding where lengths of
powers of two are not padded. Within a chunk, pieces go by descending estimated cost
(linear * n + quadratic * n**2) to the sequence with the lowest cost so far that has room; a piece
that fits nowhere is cut to fill the sequence with the most room, and its rest follows.

No shuffle and no driver work: a sequence lies within one task. Its id holds the task's partition
number, so that a task which runs again after a lost executor numbers on its own. Memory is bounded
by a chunk and a slice of texts, or by one longer document.

Defined results: a null or empty text is the end id alone. Repeated rows are packed each on their
own. Ids keep their column's type and value; rows with a null id are packed too. Other columns are
not read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from meterlake.llm.tasks import in_small_batches, parts_of_size

#: The parts of a tokenizer file that WordTokenizer works by; fixed values.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SHORT = "stmd"
LONGER = ("re", "ve", "ll")

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Code points below this one have one-to-one lower case, but for İ, and no composed forms.
LATIN_END, DOTTED = 0x250, 0x130


def kind(char: str) -> int:
    category = unicodedata.category(char)[0]
    return SPACE if char in "\t\n\v\f\r \x85\xa0" else LETTER if category == "L" else NUMBER if category == "N" else OTHER


class WordTokenizer:
    """Ids of texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    Where the file is a lower-casing BPE whose words are those of WORD_PATTERN, the words of many
    Latin texts are found at once, and each distinct word is encoded once, from a bounded cache. Texts
    beyond Latin, texts that may hold special tokens, and all texts of other files go through the
    tokenizer itself.
    """

    def __init__(self, path: str, max_words: int = 100_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_words = told.get("normalizer") == NORMALIZER and steps[0] == {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        self.by_words &= len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        self.by_words &= told["model"].get("dropout") is None and all(t["content"].startswith("<|") for t in told["added_tokens"])
        codes = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = iter(range(256, 512))
        self.bytes = {b: chr(b) if b in codes else chr(next(rest)) for b in range(256)}
        chars = [chr(c) for c in range(LATIN_END)]
        self.kinds = np.array([*map(kind, chars), SPACE], np.uint8)
        self.lower = np.array([*(ord(c.lower()[0]) for c in chars), 32], np.uint16)
        self.max_words = max_words
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def word(self, word: bytes) -> bytes:
        """The ids, little-endian uint32, of a word in UTF-16."""
        ids = self.words.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                raw = word.decode("utf-16-le").encode().decode("latin-1").translate(self.bytes)
                ids = np.array([t.id for t in self.model.tokenize(raw)], "<u4").tobytes()
            if len(self.words) >= self.max_words:
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t if isinstance(t, str) else "" for t in texts]
        if not self.by_words:
            return list(map(self.plain, texts))
        codes = np.frombuffer("\n".join([*texts, "\n\n"]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        odd = (codes >= LATIN_END) | (codes == DOTTED)
        odd[:-1] |= (codes[:-1] == ord("<")) & (codes[1:] == ord("|"))
        beyond = set(np.searchsorted(ends, np.flatnonzero(odd), "right").tolist())
        codes = np.minimum(codes, LATIN_END)
        kinds, low = self.kinds[codes], self.lower[codes]
        first = kinds != SPACE
        first[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        marks = np.flatnonzero(first & (low == ord("'")))
        marks = marks[kinds[marks + 1] == LETTER]
        one, two = low[marks + 1], low[marks + 2]
        size = np.isin(one, [ord(c) for c in SHORT]).astype(np.int64)
        for a, b in LONGER:
            size[(one == ord(a)) & (two == ord(b))] = 2
        marks, size = marks[size > 0], size[size > 0]
        after = marks + 1 + size
        first[after[kinds[after] == LETTER]] = True
        first[marks + 1] = False
        inside = kinds != SPACE
        starts = np.flatnonzero(first)
        data = low[inside]
        offsets = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, len(data)).astype(np.int32) * 2
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        held = list(map(self.word, pieces.dictionary.to_pylist()))
        flat = np.frombuffer(b"".join(held), "<u4")
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        at = pieces.indices.to_numpy()
        n = sizes[at]
        before = np.concatenate([[0], np.cumsum(n)])
        origin = (np.cumsum(sizes) - sizes)[at] - before[:-1]
        ids = flat[np.repeat(origin, n) + np.arange(before[-1])]
        bounds = before[np.searchsorted(starts, np.concatenate([[0], ends]))]
        return [self.plain(text) if i in beyond else ids[bounds[i] : bounds[i + 1]] for i, text in enumerate(texts)]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def balance(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Places (document, start, length, sequence, offset) for documents of these lengths; all sequences come out full.

    Each sequence is as long as the capacity, but for the last ones, which are powers of two.
    """
    total = sum(lengths)
    tail = total % capacity
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
    if not rooms:
        return []
    size, room, cost = np.array(rooms), np.array(rooms), np.zeros(len(rooms))
    heap = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(heap)
    out = []
    while heap:
        n, doc, start = heapq.heappop(heap)
        n = -n
        fits = room >= n
        s = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
        take = min(n, int(room[s]))
        out.append((doc, start, take, s, int(size[s] - room[s])))
        room[s] -= take
        cost[s] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(heap, (take - n, doc, start + take))
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, chunk_tokens: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, token_ids (little-endian uint32), doc_tokens, sequence_id, offset."""

    def packed(batches):
        encode = tokenizer(tokenizer_path).encode
        base, number = TaskContext.get().partitionId() << 36, 0
        ids, tokens, held = [], [], 0

        def flush():
            nonlocal ids, tokens, held, number
            rows = balance([len(t) for t in tokens], capacity)
            doc, start, length, sequence, offset = np.array(rows, np.int64).T
            own = [tokens[d][s : s + n].tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            every = pa.concat_arrays(ids).take(pa.array(doc))
            made = [every, pa.array(start), pa.array(length), pa.array(own, pa.binary()), pa.array(sizes[doc]), pa.array(sequence + (base + number)), pa.array(offset)]
            number += 1 + int(sequence.max())
            ids, tokens, held = [], [], 0
            return pa.RecordBatch.from_arrays(made, names=names)

        for batch in batches:
            for part in parts_of_size(batch, "text", 1 << 21):
                ids.append(part["doc_id"])
                tokens += [np.append(t, np.uint32(end_id)) for t in encode(part["text"].to_pylist())]
                held = sum(map(len, tokens))
                if held >= chunk_tokens:
                    yield flush()
        if tokens:
            yield flush()

    names = ["doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"]
    types = f"doc_id {docs.schema[id_col].dataType.simpleString()}, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long"
    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(packed, types)
