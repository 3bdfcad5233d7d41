"""Hard negatives by exact inner-product search, with coordinate pruning in length buckets.

Vectors of whole numbers are dealt into buckets by their length (a geometric scale), and those into shards
of about `shard_rows` by a hash of the id. A shard is one row of a table that is written once: its
vectors, and per coordinate the order of its normalised vectors by their value. Labels go into
`label_groups` groups that shards are made within, so that a search for rows of one label reads few.

A search sends each anchor to the shards that may hold a score as high as its floor, by length alone:
score <= |anchor| * longest vector. Anchors and shards meet in a partition sorted by shard: a task holds
one shard at a time and lets its anchors pass by. In a shard, the floor is turned into the least cosine
t. For the coordinates where the normalised anchor is largest in size (focus coordinates), vectors with
cosine >= t have values between cos(a + arccos t) and cos(a - arccos t), where a is the angle between the
anchor and the axis. The shortest of these ranges of the sorted lists gives the candidates, the others
are intersected with it, and a bound from the partial products of the focus coordinates thins them out.
What is left is scored exactly.

Positives are searched twice: the anchor's first shard gives a k-th score, which is the floor of the other
shards of its label. Negatives have a floor from the start, the share of the lowest positive score.

Scores are exact whole numbers. Where products may pass 2**53 candidates are scored with whole numbers
of any size; a score beyond the range of a 64-bit number counts as the end of that range.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component
take no part. Rows with the anchor's id are not its positives or negatives. Vectors of other lengths than
the anchor's are no candidates. Ties go to the smaller id. Repeated rows are candidates each; an anchor
id on several rows is one anchor, by its smallest label and vector. An anchor without positives, or
a positive without rows in its band (always so below a score of 0), gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlake.llm.balltree import HIGH, LOW
from meterlake.llm.tasks import cut, in_small_batches, parts, small_side, spread_join

#: Lengths of a bucket differ by less than this factor.
RATIO = 0.9
ANCHOR = "id bigint, label bigint, v array<bigint>"


def labelled_vectors(table: DataFrame, label: Column | str = "label", id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """id, label, v: the rows that take part, with vectors as floor(scale * x)."""
    label = F.col(label) if isinstance(label, str) else label
    rows = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _length() -> Column:
    return F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _pack(key, rows):
    """One row for a shard: vectors, ids and labels as bytes, and the sorted lists of its coordinates."""
    rows = rows.sort_by("id")
    ids, labels = (rows[c].combine_chunks().to_numpy() for c in ("id", "label"))
    v = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(ids), -1)
    unit, norms = _unit(v)
    lists = np.argsort(unit, axis=0, kind="stable").T.astype("<u4")
    made = {"shard": [key[0].as_py()], "dim": [v.shape[1]], "label_group": [key[1].as_py()], "n": [len(ids)], "low": [norms.min()], "high": [norms.max()], "label_low": [labels.min()], "label_high": [labels.max()]}
    made |= {"ids": [ids.astype("<i8").tobytes()], "labels": [labels.astype("<i8").tobytes()], "vectors": [v.tobytes()], "lists": [np.ascontiguousarray(lists).tobytes()]}
    return pa.table(made)


SHARD = "shard bigint, dim bigint, label_group bigint, n bigint, low double, high double, label_low bigint, label_high bigint, ids binary, labels binary, vectors binary, lists binary"


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((v.astype(float) ** 2).sum(1))
    return v / np.where(norms > 0, norms, 1.0)[:, None], norms


def shards_of(vectors: DataFrame, shard_rows: int = 2048, label_groups: int = 16) -> DataFrame:
    """The shards of labelled_vectors, written once."""
    keys = ["dim", "label_group", "bucket"]
    step = float(-np.log(RATIO))
    rows = vectors.select("*", F.size("v").cast("long").alias("dim"), F.pmod(F.xxhash64("label"), F.lit(label_groups)).alias("label_group"), _length().alias("norm"))
    rows = cut(rows.select("*", F.when(F.col("norm") > 0, F.floor(F.log("norm") / step)).otherwise(-1).cast("long").alias("bucket")))
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    dealt = spread_join(rows, small_side(sizes), keys).select("id", "label", "v", "label_group", F.xxhash64(*keys, F.pmod(F.xxhash64("id"), F.col("parts"))).alias("shard"))
    return cut(dealt.groupBy("shard", "label_group").applyInArrow(_pack, SHARD))


class Shard:
    """A shard in a task."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.whole = np.frombuffer(row["vectors"], "<i8").reshape(len(self.ids), -1)
        self.rows = self.whole.astype(float)
        self.unit, self.norms = _unit(self.whole)
        self.low, self.high = float(self.norms.min()), float(self.norms.max())
        self.lists = np.frombuffer(row["lists"], "<u4").reshape(self.whole.shape[1], -1)
        self.values = np.take_along_axis(self.unit.T, self.lists.astype(np.int64), 1)
        self.most = float(np.abs(self.rows).max(initial=0))

    def candidates(self, q: np.ndarray, floor: float, focus: int) -> np.ndarray:
        """Rows that may have a score of at least floor: all that do, and others."""
        norm = float(np.sqrt(q @ q))
        longest = self.high if floor > 0 else self.low
        every = np.arange(len(self.ids))
        if norm * longest == 0:
            return every if floor <= 0 or norm * self.high > 0 else every[:0]
        t = floor / (norm * longest) - 1e-9
        if t > 1 + 1e-9:
            return every[:0]
        if t <= -1 or self.low == 0:
            return every
        unit = q / norm
        at = np.argsort(-np.abs(unit), kind="stable")[:focus]
        angle, width = np.arccos(np.clip(unit[at], -1, 1)), np.arccos(min(t, 1.0))
        least = np.cos(np.minimum(angle + width, np.pi)) - 1e-9
        most = np.cos(np.maximum(angle - width, 0)) + 1e-9
        ends = [(np.searchsorted(self.values[f], a, "left"), np.searchsorted(self.values[f], b, "right")) for f, a, b in zip(at, least, most, strict=True)]
        short = min(range(len(at)), key=lambda i: ends[i][1] - ends[i][0])
        found = self.lists[at[short]][ends[short][0] : ends[short][1]].astype(np.int64)
        for i, f in enumerate(at):
            if i != short and ends[i][1] - ends[i][0] < len(self.ids):
                own = self.unit[found, f]
                found = found[(own >= least[i]) & (own <= most[i])]
        own = self.unit[found][:, at]
        rest = np.sqrt(np.maximum(1 - (unit[at] ** 2).sum(), 0) * np.maximum(1 - (own**2).sum(1), 0))
        return found[own @ unit[at] + rest >= t - 1e-9]

    def scores(self, q: list[int], at: np.ndarray) -> list[int] | np.ndarray:
        if self.most * max(map(abs, q), default=0) * len(q) < 2**53:
            return (self.rows[at] @ np.array(q, float)).astype(np.int64)
        exact = [sum(a * b for a, b in zip(row, q, strict=True)) for row in self.whole[at].tolist()]
        return np.array([min(max(s, LOW), HIGH) for s in exact], np.int64)

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The first k (score, id) by descending score, then id."""
        if len(at) > 4 * k:
            kth = np.partition(scores, len(at) - k)[len(at) - k]
            at, scores = at[scores >= kth], scores[scores >= kth]
        order = np.lexsort((self.ids[at], -scores))[:k]
        return list(zip(scores[order].tolist(), self.ids[at[order]].tolist(), strict=True))


def banded(scores: np.ndarray, positive: int, low: int, high: int, base: int) -> np.ndarray:
    """True where low * positive <= base * score <= high * positive, in whole numbers of any size."""
    return (scores >= -(-low * positive // base)) & (scores <= high * positive // base)


def meet(shards: DataFrame, asked: DataFrame, search, schema: str) -> DataFrame:
    """What search(shard, row) gives for the rows of asked and the shard that their column shard names.

    search yields tuples of the schema. Each shard goes to one partition once, before the rows for it.
    """
    sent = asked.select("shard", F.lit(1).alias("turn"), F.struct(*[c for c in asked.columns if c != "shard"]).alias("asks"))
    kept = shards.select("shard", F.lit(0).alias("turn"), F.struct("ids", "labels", "vectors", "lists").alias("holds"))
    # shards that no row asks for stay where they are
    kept = kept.join(sent.select("shard").distinct(), "shard", "left_semi")
    rows = kept.unionByName(sent, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "turn")

    def run(batches):
        held = number = None
        types = arrow
        for batch in parts(batches, 256):
            out = []
            for row in batch.to_pylist():
                if row["turn"] == 0:
                    held, number = Shard(row["holds"]), row["shard"]
                elif number == row["shard"]:
                    out += search(held, row["asks"])
            columns = list(zip(*out, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names = [c.split()[0] for c in schema.split(", ")]
    arrow = [pa.int32() if c.endswith(" int") else pa.int64() for c in schema.split(", ")]
    return in_small_batches(rows).mapInArrow(run, schema)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, base: int = 100, shard_rows: int = 2048, focus: int = 8, label_groups: int = 16) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    vectors, anchors: as from labelled_vectors. A negative has another label than the anchor, and
    low * positive_score <= base * negative_score <= high * positive_score.
    """
    shards = shards_of(vectors, shard_rows, label_groups)
    stats = small_side(shards.select("shard", "dim", "label_group", "low", "high", "label_low", "label_high"))
    group = F.pmod(F.xxhash64("label"), F.lit(label_groups))
    one = anchors.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    one = cut(one.select("*", F.size("v").cast("long").alias("dim"), group.alias("label_group"), _length().alias("norm")))

    def nearest(shard: Shard, asks: dict):
        at = np.flatnonzero((shard.labels == asks["label"]) & (shard.ids != asks["id"]))
        q = asks["v"]
        if asks["floor"] is not None and len(at):
            at = np.intersect1d(at, shard.candidates(np.array(q, float), float(asks["floor"]), focus), assume_unique=True)
        return [(asks["id"], i, s) for s, i in shard.best(at, shard.scores(q, at), positives)] if len(at) else []

    own = one.join(stats, ["dim", "label_group"]).where("label between label_low and label_high")
    first = own.groupBy("id").agg(F.max_by("shard", F.struct("high", "shard")).alias("first"))
    own = cut(own.join(first, "id").select("shard", "id", "label", "v", "norm", "high", "first"))
    found = "anchor_id bigint, positive_id bigint, score bigint"
    near = cut(meet(shards, own.where("shard = first").select("shard", "id", "label", "v", F.lit(None).cast("long").alias("floor")), nearest, found))
    floors = near.groupBy(F.col("anchor_id").alias("id")).agg(F.when(F.count("*") >= positives, F.min("score")).alias("floor"))
    # a bound below the floor by more than rounding can't be reached
    reach = F.col("floor").isNull() | (F.col("norm") * F.col("high") * (1 + 1e-9) >= F.col("floor"))
    rest = own.where("shard <> first").join(floors, "id", "left").where(reach).select("shard", "id", "label", "v", "floor")
    every = near.unionByName(meet(shards, rest, nearest, found))
    place = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    best = every.withColumn("place", F.row_number().over(place)).where(F.col("place") <= positives)
    wanted = best.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "score"))).alias("wanted"))
    wanted = cut(wanted.join(one, "id"))

    def hard(shard: Shard, asks: dict):
        bands = [(w["place"], w["positive_id"], w["score"]) for w in asks["wanted"] if w["score"] >= 0]
        least = min((-(-low * s // base) for _, _, s in bands), default=None)
        if least is None:
            return []
        q = asks["v"]
        at = shard.candidates(np.array(q, float), float(least) * (1 - 1e-12), focus)
        at = at[(shard.labels[at] != asks["label"]) & (shard.ids[at] != asks["id"])]
        scores = shard.scores(q, at) if len(at) else np.zeros(0, np.int64)
        out = []
        for place, positive, score in bands:
            good = banded(scores, score, low, high, base)
            out += ((asks["id"], positive, place, i, score, s) for s, i in shard.best(at[good], scores[good], negatives))
        return out

    least = F.array_min(F.transform("wanted", lambda w: w["score"])) * F.lit(low / base)
    others = ~((F.col("label_low") == F.col("label_high")) & (F.col("label") == F.col("label_low")))
    asked = wanted.select("id", "label", "v", "dim", "norm", "wanted", least.alias("least")).join(stats.drop("label_group"), "dim")
    asked = asked.where(others & ((F.col("least") <= 0) | (F.col("norm") * F.col("high") * (1 + 1e-9) >= F.col("least")))).select("shard", "id", "label", "v", "wanted")
    mined = meet(shards, asked, hard, "anchor_id bigint, positive_id bigint, positive_rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    return mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
