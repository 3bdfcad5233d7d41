"""Toxicity from class-conditional Kneser-Ney models.

Each class (toxic, ordinary) is a discounted word model; both back off to one shared continuation
model, the share of distinct left neighbours that a word has:

    p(w | class) = (c(class, w) - D(c(class, w))) / C(class) + L(class) * continuation(w)

c counts the word's places in the class's training texts (equal texts once). The discounts for words
counted once, twice, and three times or more come from the class's counts of counts (modified
Kneser-Ney), and L gives their sum to the shared counts, on which rare expressions so rest. A text's
evidence is the difference of its toxic and ordinary log-likelihoods, normalised by length, over three
spans: its whole length, its three most toxic words, and the most toxic one, as a few words make a long
text toxic. A logistic regression on these three turns them into a score; it learns from training texts
whose own words are taken out of the counts (leave one out).

Words are hashed to `slots` slots, so that the model has a fixed size (16 bytes a slot) and may be
broadcast. Counts are taken over all training rows and summed by a shuffle. A word's left neighbours
are its distinct pairs with the word before, by a shuffle too. About `fit_rows` of the training rows
(those whose hash of the id lies below a threshold) fit the regression.

Defined results: a null or empty text gets the score of no evidence. Null labels or ids are not
learned from; of repeated ids or equal texts with different labels the smallest (id, label) counts.
Without both classes in training every score is 0. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlake.llm import words as W
from meterlake.llm.tasks import cut, filter_texts, in_small_batches, map_texts, parts


def slots_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes % np.uint64(slots)).astype(np.int64)


def choose_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, label, place: one row per distinct labelled text; place is a hash of the id."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    own = own.groupBy("id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")).where(F.col(text_col).isNotNull())
    once = texts.join(own, "id").groupBy("text").agg(F.min(F.struct("id", "label")).alias("row")).select("row.*")
    return once.withColumn("place", F.xxhash64("id"))


def count_words(train: DataFrame, slots: int) -> DataFrame:
    """slot, c0, c1 (places by class), near (distinct left neighbours); one row per used slot."""

    def counted(batches):
        counts = np.zeros((2, slots), np.int64)
        for batch in parts(batches):
            labels = np.array(batch["label"].to_pylist())
            for b in W.blocks(batch["text"].to_pylist(), W.ALNUM):
                label = np.repeat(labels[b.first : b.first + len(b.bounds) - 1], np.diff(b.bounds))
                for y in (0, 1):
                    counts[y] += np.bincount(slots_of(b.hashes[label == y], slots), minlength=slots)
        used = np.flatnonzero(counts.any(0))
        for lo in range(0, len(used), 100_000):
            own = used[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[0, own]), pa.array(counts[1, own])], names=["slot", "c0", "c1"])

    def paired(batches):
        for batch in parts(batches):
            for b in W.blocks(batch["text"].to_pylist(), W.ALNUM):
                doc = np.repeat(np.arange(len(b.bounds) - 1), np.diff(b.bounds))
                inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
                # the slot, and 63 bits of slot and left neighbour as one number
                slot = b.hashes[inner] % np.uint64(slots)
                pair = W.mix(b.hashes[inner - 1] + W.mix(slot)) >> np.uint64(1)
                pair, at = np.unique(pair, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot[at].astype(np.int32)), pa.array(pair.view(np.int64))], names=["slot", "pair"])

    rows = train.mapInArrow(counted, "slot long, c0 long, c1 long").groupBy("slot").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    near = train.mapInArrow(paired, "slot int, pair long").distinct().groupBy("slot").agg(F.count("*").alias("near"))
    return rows.join(near, "slot", "left").select("slot", "c0", "c1", F.coalesce("near", F.lit(0)).cast("long").alias("near"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of words counted once, twice, and three times or more, from how many words there are of the first four counts."""
    if not (n1 and n2):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    return [1 - 2 * y * n2 / n1, min(max(2 - 3 * y * n3 / n2, 0.5), 2.0), min(max(3 - 4 * y * n4 / n3, 0.5), 3.0) if n3 else 0.5]


class Model:
    """Counts and shared backoff per slot, log-likelihood ratios made of them, and the weights of the regression."""

    def __init__(self, slots: int):
        self.counts = np.zeros((2, slots), np.float32)
        self.continuation = np.zeros(slots, np.float32)
        self.ratio, self.weights = np.zeros(slots, np.float32), None

    def learn(self, counts: DataFrame) -> None:
        """From count_words: one row of totals, and three small columns of used slots, come to the driver."""
        ask = [F.count_if(F.col(f"c{y}") == i).alias(f"n{y}{i}") for y in (0, 1) for i in (1, 2, 3, 4)]
        told = counts.agg(*ask, F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.sum("near").alias("near")).first()
        found = counts.select(F.col("slot").cast("int").alias("slot"), *(F.col(c).cast("float").alias(c) for c in ("c0", "c1", "near"))).toArrow()
        at = found["slot"].to_numpy()
        self.counts[:, at] = np.stack([found[c].to_numpy() for c in ("c0", "c1")])
        self.continuation[:] = 0.5
        self.continuation[at] += found["near"].to_numpy()
        self.continuation /= told["near"] + 0.5 * len(self.ratio)
        self.discount = [np.array([0.0, *discounts(*(told[f"n{y}{i}"] for i in (1, 2, 3, 4)))]) for y in (0, 1)]
        self.total = [told["c0"], told["c1"]]
        self.left = [float(self.held_back(self.counts[y], y).sum(dtype=np.float64)) / self.total[y] for y in (0, 1)]
        self.ratio = self.ratios(*self.counts, self.continuation).astype(np.float32)

    def held_back(self, counts: np.ndarray, y: int) -> np.ndarray:
        return np.minimum(self.discount[y][np.minimum(counts, 3).astype(np.int64)], counts)

    def ratios(self, c0: np.ndarray, c1: np.ndarray, continuation: np.ndarray) -> np.ndarray:
        """log p(w | toxic) - log p(w | ordinary) of words with these counts."""
        logs = [np.log((c - self.held_back(c, y)) / self.total[y] + self.left[y] * continuation) for y, c in ((0, c0), (1, c1))]
        return logs[1] - logs[0]

    def evidence(self, texts: list[str | None], labels: list[int] | None = None) -> np.ndarray:
        """Per text: ratio of the most toxic word, mean of the three most toxic, mean of all words.

        With the labels of training texts, each text's own words are taken out of its class's counts.
        """
        out = np.zeros((len(texts), 3))
        for b in W.blocks(texts, W.ALNUM):
            at = slots_of(b.hashes, len(self.ratio))
            for i in range(len(b.bounds) - 1):
                own = at[b.bounds[i] : b.bounds[i + 1]]
                if len(own):
                    used, n = np.unique(own, return_counts=True)
                    r = self.ratio[used]
                    if labels is not None:
                        counts = self.counts[:, used].astype(np.float64)
                        counts[labels[b.first + i]] -= n
                        r = self.ratios(*np.maximum(counts, 0), self.continuation[used])
                    top = np.partition(r, len(r) - 3)[-3:] if len(r) > 3 else r
                    out[b.first + i] = top.max(), top.mean(), (r * n).sum() / len(own)
        return out

    def for_scoring(self) -> Model:
        """Without the counts, which only training needs."""
        out = Model(0)
        out.ratio, out.weights = self.ratio, self.weights
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> None:
        x, w = np.c_[np.ones(len(x)), x], np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(4), x.T @ (p - y) + ridge * w)
            w -= step * min(1.0, 10 / (1e-9 + np.abs(step).max()))
        self.weights = w

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(texts)), self.evidence(texts)] @ self.weights, -30, 30)))


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", slots: int = 1 << 20, fit_rows: int = 100_000) -> Model:
    """Learns from the labels given; leave out those that are held back."""
    spark = docs.sparkSession
    chosen = cut(choose_rows(docs, labels, id_col, text_col, label_col))
    seen = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (seen.get(0) and seen.get(1)):
        return Model(slots)
    # rows of an id, a label and a hash: broadcast while they are few
    total = sum(seen.values())
    texts = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    train = texts.join(F.broadcast(chosen) if total <= 1_000_000 else chosen, "id")
    model = Model(slots)
    model.learn(cut(count_words(train.select("label", "text"), slots)))
    shared = spark.sparkContext.broadcast(model)

    def evidence(batches):
        for batch in parts(batches):
            x = shared.value.evidence(batch["text"].to_pylist(), batch["label"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["label"], *(pa.array(x[:, i]) for i in range(3))], names=["label", "a", "b", "c"])

    share = min(1.0, fit_rows / total)
    some = chosen if share == 1 else chosen.where(F.col("place") < int(2**64 * share) - 2**63)
    few = texts.join(F.broadcast(some), "id")
    x = few.select("label", "text").mapInArrow(evidence, "label int, a double, b double, c double").toArrow()
    shared.destroy()
    model.fit(np.stack([x[c].to_numpy() for c in "abc"], 1), x["label"].to_numpy().astype(float))
    return model


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.for_scoring())
    return map_texts(docs, id_col, text_col, lambda texts: {"score": shared.value.score(texts)}, {"score": ("double", pa.float64())})


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, all columns kept, that score below threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model.for_scoring())
    return filter_texts(docs, text_col, lambda texts: (shared.value.score(texts) < threshold).tolist())
