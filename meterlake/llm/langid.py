"""Language identification with a bit-sliced Bloom filter of letter n-grams.

Training counts each n-gram (letters with the gaps around words, lower-cased) per language over all
training rows, in tasks first and then by a shuffled sum. An n-gram belongs to each language where
its relative frequency is at least `share` of its highest one. All languages share one filter: an
array of `slots` 64-bit words for every 63 languages, one bit for each; an n-gram ORs its masks into
`hashes` slots. A lookup ANDs those words, which gives all languages that hold the n-gram at once.
Per text, the bits are counted per language and corrected for each language's own rate of false
positives (c - n p) / (1 - p); the highest count decides, ties go to the smaller name.

The filter takes slots * 8 bytes for every 63 languages, so it may be broadcast. The names of the
languages come to the driver, any number of them.

Defined results: a null text or one without letters gives `und` and 0. A text whose n-grams are all
unknown gets the most frequent language and 0. Training skips null texts and null languages. Without
any training row all predictions are `und` and 0. Repeated rows count as often as they stand. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlake.llm.tasks import cut, in_small_batches, map_texts
from meterlake.llm.words import mix

#: Languages for each 64-bit word of the filter.
WIDE = 63
_letters: list[np.ndarray] = []
#: Characters that one numpy block holds at most, but for a single longer text.
BLOCK_CHARS = 1 << 19


def letters() -> np.ndarray:
    """Per code point: is it a letter? Made once per worker process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def text_blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, text in enumerate(texts):
        n = len(text) if isinstance(text, str) else 0
        if i > lo and size + n > BLOCK_CHARS:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def ngrams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram whose inner characters are letters, and the number of its text."""
    joined = "\n\n" + "\n\n".join(t.lower() if isinstance(t, str) else "" for t in texts) + "\n\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    sizes = np.fromiter((len(t.lower()) + 2 if isinstance(t, str) else 2 for t in texts), np.int64, len(texts))
    codes = np.where(is_letter, codes, 0).astype(np.uint64)
    count = len(codes) - n + 1
    inner = np.ones(count, bool)
    for j in range(1, n - 1):
        inner &= is_letter[j : j + count]
    at = np.flatnonzero(inner)
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = h * np.uint64(0x110000 + 1) + codes[at + j]
    return mix(h), np.searchsorted(np.cumsum(sizes) + 1, at, "right")


def count_ngrams(train: DataFrame, n: int, label_col: str, text_col: str) -> DataFrame:
    """gram long, label, n: over all rows of train."""

    def counted(frames):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for label, own in frame.groupby("label")["text"]:
                texts = own.tolist()
                parts = [total[label]] if label in total else []
                for lo, hi in text_blocks(texts):
                    parts.append(np.unique(ngrams(texts[lo:hi], n)[0], return_counts=True))
                grams, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total[label] = grams, np.bincount(back, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)
        for label, (grams, counts) in total.items():
            for at in range(0, len(grams), 100_000):
                yield pd.DataFrame({"gram": grams[at : at + 100_000].view(np.int64), "label": label, "n": counts[at : at + 100_000]})

    rows = in_small_batches(train).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).where("label is not null and text is not null")
    return rows.mapInPandas(counted, "gram long, label string, n long").groupBy("gram", "label").agg(F.sum("n").alias("n"))


class Filter:
    """The bit-sliced filter: which languages hold an n-gram."""

    def __init__(self, labels: list[str], common: str | None, bits: np.ndarray, hashes: int):
        self.labels, self.common, self.bits, self.hashes = labels, common, bits, hashes
        fill = np.array([np.mean((bits[i // WIDE] >> np.uint64(i % WIDE)) & np.uint64(1)) for i in range(len(labels))]) if labels else np.zeros(0)
        self.false_rate = np.minimum(fill**hashes, 0.999)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Per word of languages and n-gram the languages that hold it."""
        out = np.full((len(self.bits), len(grams)), np.uint64(0xFFFFFFFFFFFFFFFF))
        for j in range(self.hashes):
            out &= self.bits[:, slot(grams, j, self.bits.shape[1])]
        return out

    def predict(self, texts: list[str | None], n: int) -> tuple[list[str], list[float]]:
        names: list[str] = []
        scores: list[float] = []
        for lo, hi in text_blocks(texts):
            own = texts[lo:hi]
            grams, at = ngrams(own, n)
            total = np.bincount(at, minlength=len(own))
            if not self.labels:
                names += ["und"] * len(own)
                scores += [0.0] * len(own)
                continue
            masks = self.masks(grams)
            hits = np.stack([np.bincount(at, ((masks[i // WIDE] >> np.uint64(i % WIDE)) & np.uint64(1)).astype(float), len(own)) for i in range(len(self.labels))], 1)
            right = np.maximum((hits - total[:, None] * self.false_rate) / (1 - self.false_rate), 0)
            best, sums = right.argmax(1), right.sum(1)
            for i, text in enumerate(own):
                if not total[i] and not (isinstance(text, str) and any(map(str.isalpha, text))):
                    names.append("und")
                    scores.append(0.0)
                elif sums[i] <= 0:
                    names.append(self.common)
                    scores.append(0.0)
                else:
                    names.append(self.labels[best[i]])
                    scores.append(float(min(1.0, right[i, best[i]] / sums[i])))
        return names, scores


def slot(grams: np.ndarray, j: int, slots: int) -> np.ndarray:
    return (mix(grams + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(slots)).astype(np.int64)


def train_filter(train: DataFrame, n: int = 3, label_col: str = "lang", text_col: str = "text", share: float = 0.2, slots: int = 1 << 19, hashes: int = 2) -> Filter:
    """Fits on all rows of train. To the driver come one row per language and at most `slots` rows."""
    counts = count_ngrams(train, n, label_col, text_col)
    counts = cut(counts)
    totals = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    labels = sorted(totals)
    words = max(1, -(-len(labels) // WIDE))
    bits = np.zeros((words, slots), np.uint64)
    if labels:
        names = counts.sparkSession.createDataFrame([(label, totals[label], i // WIDE, 1 << (i % WIDE)) for i, label in enumerate(labels)], "label string, total long, word int, bit long")
        rated = counts.join(F.broadcast(names), "label").select("gram", "word", "bit", (F.col("n") / F.col("total")).alias("rate"))
        rows = rated.groupBy("gram").agg(F.collect_list(F.struct("rate", "word", "bit")).alias("all"), F.max("rate").alias("top"))
        held = rows.select("gram", F.explode(F.filter("all", lambda x: x["rate"] >= F.lit(share) * F.col("top"))).alias("x"))
        rows = held.groupBy("gram", "x.word").agg(F.bit_or("x.bit").alias("mask"))

        def placed(frames):
            held = np.zeros((words, slots), np.uint64)
            for frame in frames:
                grams, masks = frame["gram"].to_numpy(np.int64).view(np.uint64), frame["mask"].to_numpy(np.int64).view(np.uint64)
                for j in range(hashes):
                    np.bitwise_or.at(held, (frame["word"].to_numpy(), slot(grams, j, slots)), masks)
            for word, at in ((i, np.flatnonzero(held[i])) for i in range(words)):
                yield pd.DataFrame({"word": word, "slot": at, "mask": held[word, at].view(np.int64)})

        found = rows.mapInPandas(placed, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
        bits[found["word"].to_numpy(), found["slot"].to_numpy()] = found["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return Filter(labels, min(labels, key=lambda x: (-totals[x], x), default=None), bits, hashes)


def identify(docs: DataFrame, model: Filter, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(texts):
        names, scores = shared.value.predict(texts, n)
        return {"lang_pred": names, "score": scores}

    return map_texts(docs, id_col, text_col, predicted, {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64())})
