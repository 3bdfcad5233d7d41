"""Near-duplicate documents by one-permutation MinHash.

A document's set holds its distinct word shingles. One pass hashes each shingle once; the hash range
is cut into bins, and a bin's smallest hash is its value. Empty bins take the value of a filled bin
chosen by a hash sequence of the bin's own number (optimal densification), so short sets work too.
Documents with equal sets form a class, of which the smallest id stands for all.

Bands of bin values are bucketed. Within a bucket every member gets an edge to one center, the
smallest id, so candidate edges form stars and grow with the members, never with their square. Edges
are confirmed on the full sets, and components of the links follow.

A star misses links between members that are both unlike the center. So the groups that candidate
edges connect, and that still hold several components, are compared once more: every member outside
the largest component of a group against all members of other components, with exact intersections
counted over an inverted index of the sets. Only links that join two components leave a task, so no
row per pair is made. Groups are dealt into blocks of bounded size, and pairs of blocks are the rows
that Spark deals to tasks. No link between members of one group is lost, at any size.

Where a group has more than a block of such members, as pages of one template do that are alike but
not enough, a prefix filter comes first: of sets with a similarity of t or more, the (1 - t) n + 1
shingles that are rarest in the group have one in common, so members whose rarest shingles nobody of
another component has among theirs link nothing, and stay out of the blocks. A template's shingles are the
most frequent ones, so they are keys only of sets that are nearly similar enough.

Components come from alternating large-star and small-star steps over links, each cut by a
checkpoint. All joins on keys that may be hot are dealt so that adaptive execution can split them.

Defined results: a document without words has an empty set, is linked with nothing and stands for
itself. Rows with a null id have a null component and are kept. Rows that repeat an id are all
reported, each with the component of its own text, and kept if their id is its component's smallest.
Ids are read as 64-bit numbers. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlake.llm import words as W
from meterlake.llm.tasks import columns_of, cut, in_small_batches, parts, small_side, spread_join

BANDS, ROWS = 30, 4
BINS = BANDS * ROWS


def shingle_sets(texts: list[str | None], k: int):
    """Distinct shingle hashes per text, sorted; the whole sequence as one where a text has fewer than k words."""
    for b in W.blocks(texts, W.SPACED):
        g = W.grams(b.hashes, k)
        for lo, hi in zip(b.bounds[:-1].tolist(), b.bounds[1:].tolist(), strict=True):
            n = hi - lo
            if n >= k:
                yield np.unique(g[lo : hi - k + 1])
            elif n:
                yield W.grams(b.hashes[lo:hi], n) + np.uint64(n)
            else:
                yield np.zeros(0, np.uint64)


_probes: list[np.ndarray] = []


def probes() -> np.ndarray:
    """For each bin a sequence of bins to borrow from; the same for all documents."""
    if not _probes:
        grid = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(4096) + np.arange(8 * BINS, dtype=np.uint64)
        _probes.append((W.mix(grid + np.uint64(77)) % np.uint64(BINS)).astype(np.int64))
    return _probes[0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest hash per bin, densified; shingles sorted and not empty."""
    width = np.uint64((1 << 64) // BINS + 1)
    bins = (shingles // width).astype(np.int64)
    filled, first = np.unique(bins, return_index=True)
    values = np.zeros(BINS, np.uint64)
    has = np.zeros(BINS, bool)
    values[filled], has[filled] = shingles[first], True
    if len(filled) < BINS:
        empty = np.flatnonzero(~has)
        hit = has[probes()[empty]]
        at = hit.argmax(1)
        donor = np.where(hit.any(1), probes()[empty, at], filled[0])
        values[empty] = W.mix(values[donor])
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, s1, s2 (digest of the set) and bands of every row."""

    def made(batches):
        for batch in parts(batches):
            n, s1, s2, bands = [], [], [], []
            for s in shingle_sets(batch["text"].to_pylist(), k):
                n.append(len(s))
                s1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                s2.append(int(W.mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                bands.append(band_keys(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "s1", "s2", "bands"])

    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(made, "id long, n long, s1 long, s2 long, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, hashes (the sorted set as 64-bit numbers) of the documents whose id stands in ids."""

    def made(batches):
        for batch in parts(batches):
            sets = [s.tobytes() for s in shingle_sets(batch["text"].to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.binary())], names=["id", "hashes"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.join(ids, "id", "left_semi").mapInArrow(made, "id long, hashes binary").dropDuplicates(["id", "hashes"])


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges with 100 * intersection >= percent * union of the full sets."""
    both = spread_join(edges, sets.toDF("src", "a"), ["src"])
    both = spread_join(both, sets.toDF("dst", "b"), ["dst"])

    def kept(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                same = len(np.intersect1d(a, b, assume_unique=True))
                good.append(bool(same) and 100 * same >= percent * (len(a) + len(b) - same))
            yield batch.filter(pa.array(good, pa.bool_())).select(["src", "dst"])

    return both.select("src", "dst", "a", "b").mapInArrow(kept, "src long, dst long").distinct()


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Does each u stand once, and never as a v? One job, which gives one number."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("end")), F.struct(F.col("v").alias("x"), F.lit(0).alias("n"), F.lit(1).alias("end")))).alias("e")).select("e.*")
    each = ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("end").alias("end"))
    return not each.agg(F.count_if((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("end") > 0)))).first()[0]


def components(links: DataFrame, max_steps: int = 50) -> DataFrame:
    """id, component (smallest id reachable) of all ids that stand in links (src, dst).

    Steps needed grow with the logarithm of the longest path; where max_steps do not settle it, an error is raised.
    """
    edges = cut(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    for _ in range(max_steps):
        if is_forest_of_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = spread_join(large, low, ["u"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
    else:
        raise RuntimeError("components did not settle")
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def crowds(first: DataFrame) -> DataFrame:
    """key, id, center of all members of buckets with several; the center is the smallest id. first: id, bands."""
    members = first.select("id", F.explode("bands").alias("key"))
    low = members.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("hi")).where("center < hi").select("key", "center")
    return spread_join(members, small_side(low), ["key"])


def mixed_units(edges: DataFrame, found: DataFrame) -> DataFrame:
    """unit, id, part, few: members of the groups that edges connect and that hold several components; few marks those outside the largest."""
    groups = components(edges).withColumnRenamed("component", "unit")
    units = cut(groups.join(found, "id", "left").select("unit", "id", F.coalesce("component", "id").alias("part")))
    parts_of = units.groupBy("unit", "part").agg(F.count("*").alias("n")).groupBy("unit").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.count("*").alias("n"))
    mixed = small_side(parts_of.where("n > 1").select("unit", "main"))
    return spread_join(units, mixed, ["unit"]).select("unit", "id", "part", (F.col("part") != F.col("main")).alias("few"))


def with_rare_partners(units: DataFrame, sets: DataFrame, percent: int, crowded: int) -> DataFrame:
    """The units without members that can link nothing; units of at most `crowded` members to look for stay as they are."""
    units = cut(units)
    many = cut(units.groupBy("unit").agg(F.count_if("few").alias("n")).where(F.col("n") > crowded).select("unit"))
    n = many.count()
    if not n:
        return units
    many = F.broadcast(many) if n <= 1_000_000 else many
    calm, busy = units.join(many, "unit", "left_anti"), units.join(many, "unit", "left_semi")

    def spread_out(batches):
        for batch in batches:
            for part in parts([batch]):
                held = [np.frombuffer(x.as_buffer(), np.int64) for x in part["hashes"]]
                n = np.fromiter(map(len, held), np.int64, len(held))
                at = pa.array(np.repeat(np.arange(len(held)), n))
                columns = [part[c].take(at) for c in ("unit", "id", "part", "few")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(n, n)), pa.array(np.concatenate([np.zeros(0, np.int64), *held]))], names=["unit", "id", "part", "few", "size", "shingle"])

    each = spread_join(busy, sets, ["id"]).select("unit", "id", "part", "few", "hashes").mapInArrow(spread_out, "unit long, id long, part long, few boolean, size long, shingle long")
    shared = each.groupBy("unit", "shingle").agg(F.count("*").alias("n")).where("n > 1")
    known = spread_join(each, shared, ["unit", "shingle"])
    # shingles that nobody else has come first in the order, and are no keys
    own = known.groupBy("unit", "id", "part", "few", "size").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("keys"))
    least = F.ceil(F.col("size") * percent / 100)
    first = F.greatest(F.col("size") - least + 1 - (F.col("size") - F.size("keys")), F.lit(0)).cast("int")
    keys = cut(own.select("unit", "id", "part", "few", F.explode(F.slice("keys", F.lit(1), first)).alias("key")).select("unit", "id", "part", "few", "key.shingle"))
    live = keys.groupBy("unit", "shingle").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.max("few").alias("few")).where("few and lo < hi").select("unit", "shingle")
    left = spread_join(keys, live, ["unit", "shingle"]).select("unit", "id", "part", "few").distinct()
    return cut(calm.unionByName(left))


def blocks_of_units(units: DataFrame, sets: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """unit, block, blocks, members: the units' members with their sets, in blocks of about block_rows rows or block_bytes."""
    full = spread_join(units, sets, ["id"])
    sizes = units.join(sets.select("id", F.octet_length("hashes").alias("bytes")), "id").groupBy("unit").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    n = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    full = spread_join(full, small_side(sizes.select("unit", n.alias("blocks"))), ["unit"])
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return full.groupBy("unit", block.alias("block"), "blocks").agg(F.collect_list(F.struct("id", "part", "few", "hashes")).alias("members"))


def block_links(few: list[dict], all_: list[dict], percent: int) -> list[tuple[int, int]]:
    """Pairs of similar sets that join different parts; of several between the same parts only the first found."""
    asked = [x for x in few if x["few"]]
    sets = [np.frombuffer(y["hashes"], np.uint64) for y in all_]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
    names = {p: i for i, p in enumerate(dict.fromkeys(x["part"] for x in (*few, *all_)))}
    label = np.arange(len(names))
    part = np.array([names[y["part"]] for y in all_])
    out = []
    for x in asked:
        own = np.frombuffer(x["hashes"], np.uint64)
        lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        same = np.bincount(owner[at], minlength=len(sets))
        good = np.flatnonzero((same > 0) & (100 * same >= percent * (len(own) + sizes - same)))
        me = names[x["part"]]
        for j in good[label[part[good]] != label[me]].tolist():
            if label[part[j]] != label[me]:
                label[label == label[part[j]]] = label[me]
                out.append((max(x["id"], all_[j]["id"]), min(x["id"], all_[j]["id"])))
    return out


def rest_links(units: DataFrame, sets: DataFrame, percent: int, block_rows: int = 512, block_bytes: int = 1 << 21) -> DataFrame:
    """src, dst: links between different parts of the same unit, enough of them to join all parts that links join."""
    held = cut(blocks_of_units(with_rare_partners(units, sets, percent, block_rows), sets, block_rows, block_bytes))
    # a unit of one block meets itself; of several, each block with members to look for meets every block
    alone = held.where("blocks = 1").select("members", F.lit(None).cast(held.schema["members"].dataType).alias("others"))
    asked = held.where(F.col("blocks") > 1).where(F.exists("members", lambda x: x["few"]))
    refs = asked.select("unit", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = spread_join(refs, held.select("unit", "block", "members"), ["unit", "block"])
    pairs = spread_join(pairs, held.select("unit", F.col("block").alias("other"), F.col("members").alias("others")), ["unit", "other"])

    def found(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                few, others = batch["members"][i].as_py(), batch["others"][i].as_py()
                links = block_links(few, few if others is None else others, percent)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["src", "dst"])

    return alone.unionByName(pairs.select("members", "others")).mapInArrow(found, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, block_rows: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for every row."""
    every = cut(sketches(docs, k, id_col, text_col))
    some = every.where("id is not null and n > 0")
    classes = some.groupBy("s1", "s2", "n").agg(F.min("id").alias("id"))
    first = some.join(classes, ["s1", "s2", "n", "id"], "left_semi").dropDuplicates(["id", "s1", "s2", "n"])
    crowd = cut(crowds(first.select("id", "bands")))
    edges = cut(crowd.where("id <> center").select(F.col("id").alias("src"), F.col("center").alias("dst")).distinct())
    near = small_side(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    sets = cut(full_sets(docs, near, k, id_col, text_col))
    links = cut(confirmed(edges, sets, percent))
    found = cut(components(links))
    more = rest_links(mixed_units(edges, found), sets, percent, block_rows)
    links = cut(found.select(F.col("id").alias("src"), F.col("component").alias("dst")).unionByName(more))
    found = cut(components(links))
    named = classes.join(found.withColumnRenamed("component", "c"), "id", "left").select("s1", "s2", "n", F.coalesce("c", "id").alias("component_id"))
    own = spread_join(every.select("id", "s1", "s2", "n"), named, ["s1", "s2", "n"], "left")
    result = own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component_id", "id")).alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, but for those that a smaller id of their group stands for."""
    gone = near_duplicates(docs, k, percent, id_col=id_col, text_col=text_col).where("not kept").select(F.col(id_col)).distinct()
    gone = small_side(gone)
    return docs.join(gone, id_col, "left_anti").select(*columns_of(docs))
