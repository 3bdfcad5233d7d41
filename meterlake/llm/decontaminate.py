"""Benchmark decontamination by winnowing.

Items and documents are lower-cased (A-Z) and cut into words. Of each text, the k-word grams with
the smallest hash in some window of w grams are its fingerprints. With k + w - 1 = window words,
two texts that share `window` consecutive words share a fingerprint. Items' fingerprints meet the
documents' in a hash lookup inside each document task; hits are extended to all windows around
them, which are confirmed against the items' window hashes.

The items are the small side. They are split into blocks by their measured size, each of at most
`block_bytes` of text (or one longer item); each block is broadcast on its own, so that what an
executor holds is bounded however many items there are. Texts are never shuffled, and for one block no
row is. For several, a Bloom filter of all items' fingerprints, of a fixed size, first leaves the
documents that may have a hit; only these are held against each block. Their hits meet again by id and
digest of the text, so that each row gets the hits of its own text.

Defined results: a null or empty text has no words and no hit. An item without words is ignored;
an item of fewer than `window` words is one window. Repeated items count by item id; items with a
null id are ignored. Every document row is reported on its own, repeated ids and null ids too,
however many blocks there are. Item ids are read as 64-bit numbers. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meterlake.llm import words as W
from meterlake.llm.tasks import columns_of, cut, filter_texts, map_texts, parts, small_side

SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
HITS = {"n_words": ("long", pa.int64()), "hits": ("array<struct<start:long,end:long>>", pa.list_(SPAN)), "items": ("array<long>", pa.list_(pa.int64()))}


class Index:
    """Windows of a bounded block of items: sorted hashes by window length, with the items of each."""

    def __init__(self, ids: list[int], texts: list[str | None], window: int, k: int):
        self.window, self.k, self.w = window, k, window - k + 1
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        marks = []
        ids_array = np.asarray(ids, np.int64)
        for b in W.blocks(texts, W.ALNUM):
            sizes = np.diff(b.bounds)
            item = np.repeat(ids_array[b.first : b.first + len(sizes)], sizes)
            left, sums = W.left_in_text(b.bounds), W.gram_sums(b.hashes)
            marks.append(W.winnow(b.hashes, left, k, self.w)[1])
            whole = np.repeat(sizes, sizes)
            for n in np.unique(np.minimum(sizes, window)).tolist():
                if n:
                    g = W.grams(b.hashes, n, sums)
                    own = np.minimum(whole, window)[: len(g)] == n
                    at = np.flatnonzero(own & (left[: len(g)] >= n))
                    found.setdefault(n, []).append((g[at], item[at]))
        self.marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
        self.windows = {}
        #: hashes one of which every text with a hit has: winnowed ones of whole windows, and short items
        self.signs = np.concatenate([self.marks, *(h for n, pairs in found.items() if n < window for h, _ in pairs)]) if found else self.marks
        for n, held in found.items():
            pairs = np.unique(np.rec.fromarrays([np.concatenate([p[i] for p in held]) for i in (0, 1)], names="h,owner"))
            hashes, first = np.unique(pairs.h, return_index=True)
            self.windows[n] = (hashes, np.append(first, len(pairs)), np.asarray(pairs.owner))

    @property
    def lengths(self) -> list[int]:
        """Numbers of words of the windows."""
        return sorted(self.windows)

    def _in(self, sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Index into sorted_hashes, or -1."""
        if not len(sorted_hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
        return np.where(sorted_hashes[at] == h, at, -1)

    def occurrences(self, b: W.Block):
        """(word index, window length, index into the window table) of each occurrence in the block."""
        left, sums = W.left_in_text(b.bounds), W.gram_sums(b.hashes)
        for n, (hashes, _, _) in self.windows.items():
            g = W.grams(b.hashes, n, sums)
            if n == self.window:
                at, marks = W.winnow(b.hashes, left, self.k, self.w)
                at = at[self._in(self.marks, marks) >= 0]
                at = np.unique((at[:, None] - np.arange(self.w)).ravel())
                at = at[(at >= 0) & (at < len(g))]
            else:
                at = np.arange(len(g))
            at = at[left[at] >= n]
            row = self._in(hashes, g[at])
            yield at[row >= 0], n, row[row >= 0]

    def search(self, texts: list[str | None]):
        """Per text: number of words, merged hit intervals of words, item ids."""
        for b in W.blocks(texts, W.ALNUM):
            delta = np.zeros(len(b.hashes) + 1, np.int64)
            rows: list[tuple[np.ndarray, int, np.ndarray]] = []
            for at, n, row in self.occurrences(b):
                np.add.at(delta, at, 1)
                np.add.at(delta, at + n, -1)
                rows.append((at, n, row))
            hit = np.concatenate([[False], np.cumsum(delta[:-1]) > 0, [False]])
            count = len(b.bounds) - 1
            items: list[set] = [set() for _ in range(count)]
            for at, n, row in rows:
                _, first, owner = self.windows[n]
                text = np.searchsorted(b.bounds, at, "right") - 1
                for t, r in np.unique(np.stack([text, row], 1), axis=0).tolist() if len(at) else ():
                    items[t].update(owner[first[r] : first[r + 1]].tolist())
            for i in range(count):
                lo, hi = b.bounds[i], b.bounds[i + 1]
                spans = []
                if items[i]:
                    inside = np.concatenate([[False], hit[lo + 1 : hi + 1], [False]]).astype(np.int8)
                    edge = np.diff(inside)
                    spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
                yield int(hi - lo), spans, sorted(items[i])


def find_hits(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, hits (word intervals, end exclusive), items (ids of items with occurring windows)."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null")
    every_doc = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + int(total) // block_bytes
    docs = every_doc if n_blocks == 1 else cut(maybe_hit(every_doc.select(F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("doc_id"), "text"), items, window, k).distinct())
    found = []
    for block in range(n_blocks):
        own = (items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)).toArrow()
        index = docs.sparkSession.sparkContext.broadcast(Index(own["item_id"].to_pylist(), own["text"].to_pylist(), window, k))

        def search(texts, index=index):
            made = list(index.value.search(texts))
            return {"n_words": [f[0] for f in made], "hits": [[{"start": a, "end": e} for a, e in f[1]] for f in made], "items": [f[2] for f in made]}

        found.append(map_texts(docs, "doc_id", "text", search, HITS))
    if n_blocks == 1:
        return found[0]
    every = found[0].where(F.size("items") > 0)
    for part in found[1:]:
        every = every.unionByName(part.where(F.size("items") > 0))
    hits = merge_spans(every.select("doc_id", F.explode("hits").alias("x")).select("doc_id", "x.*"))
    owned = every.select("doc_id", F.explode("items").alias("item")).groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    merged = hits.join(owned, "doc_id").select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.digest").alias("__digest"), "hits", "items")
    counts = map_texts(every_doc.select(F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("row"), "text"), "row", "text", lambda texts: {"n_words": list(W.counts(texts, W.ALNUM))}, {"n_words": HITS["n_words"]})
    own = counts.join(merged, F.col("row.doc_id").eqNullSafe(F.col("__id")) & (F.col("row.digest") == F.col("__digest")), "left")
    nothing = lambda c: F.coalesce(c, F.array().cast(HITS[c][0])).alias(c)
    return own.select("row.doc_id", "n_words", nothing("hits"), nothing("items"))


def maybe_hit(docs: DataFrame, items: DataFrame, window: int, k: int, bits: int = 1 << 26) -> DataFrame:
    """The rows of docs that a Bloom filter of the items' signs does not rule out."""

    def signed(batches):
        held, lengths = np.zeros(bits // 64, np.uint64), set()
        for batch in parts(batches):
            index = Index([0] * batch.num_rows, batch["text"].to_pylist(), window, k)
            at = W.mix(index.signs) % np.uint64(bits)
            np.bitwise_or.at(held, (at // np.uint64(64)).astype(np.int64), np.uint64(1) << (at % np.uint64(64)))
            lengths |= set(index.lengths)
        at = np.append(np.flatnonzero(held), [-n for n in sorted(lengths)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.where(at < 0, 0, held[at]).view(np.int64))], names=["word", "bits"])

    # at most one row per word of the filter, and one, with a negative number, per length of windows
    made = items.select("text").mapInArrow(signed, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    at, values = made["word"].to_numpy(), made["bits"].to_numpy().astype(np.int64).view(np.uint64)
    held = np.zeros(bits // 64, np.uint64)
    held[at[at >= 0]] = values[at >= 0]
    lengths = [-int(n) for n in at[at < 0]]
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def known(hashes):
        at = W.mix(hashes) % np.uint64(bits)
        return (shared.value[(at // np.uint64(64)).astype(np.int64)] >> (at % np.uint64(64))) & np.uint64(1) != 0

    def keep(texts):
        out = np.zeros(len(texts), bool)
        for b in W.blocks(texts, W.ALNUM):
            left, sums = W.left_in_text(b.bounds), W.gram_sums(b.hashes)
            for n in lengths:
                at, h = W.winnow(b.hashes, left, k, window - k + 1) if n == window else (np.flatnonzero(left >= n), None)
                h = W.grams(b.hashes, n, sums)[at] if h is None else h
                out[b.first + np.searchsorted(b.bounds, at[known(h)], "right") - 1] = True
        return out.tolist()

    return filter_texts(docs, "text", keep)


def merge_spans(spans: DataFrame) -> DataFrame:
    """doc_id, hits: the intervals (doc_id, start, end) of each document in order, joined where they touch or overlap."""
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1))
    numbered = spans.withColumn("opened", opened).withColumn("n", F.sum("opened").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    one = numbered.groupBy("doc_id", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits"))


def n_hit(col: str = "hits") -> F.Column:
    """Words inside merged intervals."""
    return F.aggregate(col, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def drop_contaminated(docs: DataFrame, items: DataFrame, max_share: float = 0.0, **kw) -> DataFrame:
    """The documents, all their columns kept, of which at most max_share of the words are hit; null ids and texts stay."""
    found = find_hits(docs, items, **kw).where((F.size("hits") > 0) & (n_hit() > F.lit(max_share) * F.col("n_words"))).select("doc_id").distinct()
    found = small_side(found)
    return docs.join(found, "doc_id", "left_anti").select(*columns_of(docs))
