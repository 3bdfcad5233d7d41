"""Repeated and nearly repeated lines by a segment-partition edit join.

Lines are normalised (lower case, white space collapsed) and known by a 64-bit hash. Every line that
is not empty takes part as an exact repeat; those of at least `min_chars` characters also take part
as near repeats. Equal lines are one class, whose first place is its smallest (document, line
number). Each line of length L is cut into threshold + 1 segments, indexed by (L, segment number,
segment). A line probes the segments of its own and of the up to `threshold` shorter lengths with the
substrings at the few offsets an alignment within the threshold allows. Two lines within the threshold
must share a segment. A pair that shares one must also agree in a 64-bit parity sketch of its letter
pairs up to 4 bits per edit, a test which never loses a pair within the threshold. What passes is
verified on the texts by a banded bit-parallel edit distance.

Pairs are no rows of the marks of lines. What passes the sketch makes a line a member of the group of that
segment, a group of many members is tiled, and each member takes its text to its groups once. A task holds one
group, compares all of it, and gives one row a member: the number of its links and the earliest of them. A pair that
meets in several groups counts in the smallest number of a group that both are in. Only `links` gives pairs.

One pass over the texts makes the index and probe rows. They are hashed, packed by ranges of keys into
byte strings, and dealt to one partition per range, where a sort brings equal segments together and
repeats of a line fall away. A segment that very many different lines share is neither held nor compared
there: as soon as what a task holds passes `held_bytes`, such segments leave in blocks of `block_rows`, and
so does what comes for them later; pairs of blocks are dealt to tasks of their own. Texts are never
shuffled but for candidate lines: a Bloom filter of their places, sized by their number, keeps the other
lines from it.

A class is removed if a class within the threshold has an earlier first place; of the other classes
the first place is kept.

Defined results: null and empty texts have no lines, and lines of white space take no part and always
stay. Rows with a null id take no part; rows that repeat an id count as one document whose lines have
equal numbers. Ids are read as 64-bit numbers. Other columns are kept by remove_lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlake.llm import words as W
from meterlake.llm.tasks import columns_of, cut, in_small_batches, parts, parts_of_size, small_side, spread_join

#: Characters that one block holds at most, but for a single longer line.
BLOCK_CHARS = 1 << 18
#: Characters whose keys a task packs together.
PACK_CHARS = 1 << 21
#: Bytes of text for each range of keys; the keys of a range take at most 12 times as much.
RANGE_BYTES = 1 << 23
#: Least and most bits of the filter of candidate lines; beyond 2^24 of these, more of the other lines pass it.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Members of a tile of a group: a group holds at most two tiles.
TILE = 1024

KEYS = np.dtype([("key", "<u8"), ("id", "<i8"), ("sketch", "<u8")])
PLACES = np.dtype([("doc_id", "<i8"), ("line_no", "<i4"), ("id", "<i8")])


def normal_lines(text: str | None) -> list[tuple[int, str]]:
    """(line number, normalised line) of the lines that are not empty."""
    if not isinstance(text, str):
        return []
    lines = ((i, " ".join(line.split())) for i, line in enumerate(text.lower().split("\n")))
    return [(i, line) for i, line in lines if line]


class Lines:
    """Some lines as one array of code points with the prefix sums that hash any substring."""

    def __init__(self, lines: list[str]):
        self.codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.sums = W.prefix((self.codes + np.uint64(1)) * W.powers(W._BASE, len(self.codes)))

    def hashes(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return W.mix((self.sums[at + size] - self.sums[at]) * W.powers(W._BASE_INV, len(self.codes) + 1)[at])

    def ids(self) -> np.ndarray:
        return W.mix(self.hashes(self.starts, self.sizes) + self.sizes.astype(np.uint64))

    def parity(self) -> np.ndarray:
        """Per line the XOR of one bit per pair of neighbouring characters; one edit flips at most 4 bits."""
        bits = np.uint64(1) << ((self.codes[:-1] * np.uint64(0x110000) + self.codes[1:]) * W._BASE >> np.uint64(58))
        all_before = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bits)]) if len(bits) else np.zeros(1, np.uint64)
        return all_before[self.starts + self.sizes - 1] ^ all_before[self.starts]

    def letters(self) -> np.ndarray:
        """Per line the XOR of one bit per character; one edit flips at most 2 bits."""
        bits = np.uint64(1) << (W.mix(self.codes) >> np.uint64(58))
        all_before = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bits)])
        return all_before[self.starts + self.sizes] ^ all_before[self.starts]


def segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of lines of these lengths; the longer segments come last."""
    small, more = length // parts, length % parts
    return i * small + np.maximum(0, i - (parts - more)), small + (i >= parts - more)


def probe_offsets(threshold: int) -> list[tuple[int, int, int]]:
    """(characters longer, segment number, offset from the segment's start) of all substrings to look up."""
    return [(d, i, off) for d in range(threshold + 1) for i in range(threshold + 1) for off in range(max(-i, d - (threshold - i)), min(i, d + threshold - i) + 1)]


def keys_of(lines: Lines, own: np.ndarray, threshold: int, indexed: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line numbers, keys) of the indexed segments, or of the probes, of the lines whose numbers stand in own."""
    parts = threshold + 1
    sizes, starts = lines.sizes[own], lines.starts[own]
    for d, i, off in [(0, i, 0) for i in range(parts)] if indexed else probe_offsets(threshold):
        other = sizes - d
        start, size = segment(other, i, parts)
        at = start + off
        good = np.flatnonzero((other >= parts) & (at >= 0) & (at + size <= sizes))
        salt = (other[good] * 16 + i).astype(np.uint64)
        yield own[good], W.mix(lines.hashes(starts[good] + at[good], size[good]) + salt)


def blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, Lines]]:
    """(ids of documents, line numbers, lines) by blocks of a batch of (doc_id, text)."""
    docs, numbers, lines, held = [], [], [], 0
    for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
        for i, line in normal_lines(text):
            docs.append(doc)
            numbers.append(i)
            lines.append(line)
            held += len(line)
            if held >= BLOCK_CHARS:
                yield np.array(docs, np.int64), np.array(numbers, np.int32), Lines(lines)
                docs, numbers, lines, held = [], [], [], 0
    if lines:
        yield np.array(docs, np.int64), np.array(numbers, np.int32), Lines(lines)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")


OCCURRENCE, INDEX, PROBE, PAIR, MEMBER = range(5)


def packed_rows(texts: DataFrame, threshold: int, min_chars: int, ranges: int) -> DataFrame:
    """range, kind, data: index and probe rows (KEYS) by ranges of keys, and places of lines (PLACES) in any range."""

    def packed(batches):
        turn = 0
        held: dict[int, list[np.ndarray]] = {INDEX: [], PROBE: []}
        chars = 0

        def row(at, kind, data):
            return at, kind, data.tobytes()

        def flush():
            out = []
            for kind, arrays in held.items():
                rows = np.concatenate([np.zeros(0, KEYS), *arrays])
                if len(rows):
                    at = (rows["key"] % np.uint64(ranges)).astype(np.int64)
                    order = np.argsort(at, kind="stable")
                    used, first = np.unique(at[order], return_index=True)
                    out += [row(r, kind, rows[order[lo:hi]]) for r, lo, hi in zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(rows)], strict=True)]
                    arrays.clear()
            if out:
                yield batch_of(out)

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["range", "kind", "data"])

        for part in parts(batches):
            for doc, number, lines in blocks_of(part):
                ids = lines.ids().view(np.int64)
                places = np.zeros(len(ids), PLACES)
                places["doc_id"], places["line_no"], places["id"] = doc, number, ids
                turn += 1
                yield batch_of([row((turn * 7919 + int(ids[0])) % ranges, OCCURRENCE, places)])
                own = np.unique(ids, return_index=True)[1]
                own = own[lines.sizes[own] >= min_chars]
                sketch = lines.parity()
                for kind in (INDEX, PROBE):
                    for at, keys in keys_of(lines, own, threshold, kind == INDEX):
                        rows = np.zeros(len(at), KEYS)
                        rows["key"], rows["id"], rows["sketch"] = keys, ids[at], sketch[at]
                        held[kind].append(rows)
                chars += int(lines.sizes.sum())
                if chars >= PACK_CHARS:
                    yield from flush()
                    chars = 0
        yield from flush()

    return texts.mapInArrow(packed, "range int, kind int, data binary")


def once(rows: np.ndarray) -> np.ndarray:
    """The rows sorted by key and id, each (key, id) once."""
    rows = rows[np.lexsort((rows["id"], rows["key"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["id"][1:] != rows["id"][:-1])
    return rows[new]


def near(probe: np.ndarray, lo: np.ndarray, hi: np.ndarray, index: np.ndarray, threshold: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in probe, places in index) of each probe with the index rows lo .. hi of other lines whose sketches allow the threshold."""
    total = np.cumsum(hi - lo)
    at = 0
    while at < len(probe):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        n = (hi - lo)[at:end]
        a = np.repeat(np.arange(at, end), n)
        b = np.repeat(lo[at:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        kept = (np.bitwise_count(probe["sketch"][a] ^ index["sketch"][b]) <= 4 * threshold) & (probe["id"][a] != index["id"][b])
        yield a[kept], b[kept]
        at = end


def matches(probe: np.ndarray, lo: np.ndarray, hi: np.ndarray, index: np.ndarray, threshold: int) -> Iterator[np.ndarray]:
    """Pairs (smaller id, larger id) of near."""
    for a, b in near(probe, lo, hi, index, threshold):
        a, b = probe["id"][a], index["id"][b]
        yield np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)


def tiled(groups: np.ndarray, ids: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(groups, ids): a group of over `tile` members as groups of two tiles of it each, so that any two members meet. Sorted by group."""
    _, first, n = np.unique(groups, return_index=True, return_counts=True)
    large = n > tile
    out = [(groups[~np.repeat(large, n)], ids[~np.repeat(large, n)])]
    for at, count in zip(first[large].tolist(), n[large].tolist(), strict=True):
        tiles = [ids[x : min(x + tile, at + count)] for x in range(at, at + count, tile)]
        for i in range(len(tiles)):
            for j in range(i + 1, len(tiles)):
                own = np.concatenate([tiles[i], tiles[j]])
                out.append((np.full(len(own), W.mix(groups[at : at + 1] + np.uint64(i * len(tiles) + j + 1))[0]), own))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def members(probe: np.ndarray, lo: np.ndarray, hi: np.ndarray, index: np.ndarray, threshold: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """(groups, ids) of the lines that near gives, by the keys of their rows."""
    found = [np.zeros(0, KEYS)]
    for a, b in near(probe, lo, hi, index, threshold):
        found.append(once(np.concatenate([probe[np.unique(a)], index[np.unique(b)]])))
    own = once(np.concatenate(found))
    return tiled(own["key"], own["id"], tile)


def found_rows(packed: DataFrame, threshold: int, hot: int, block_rows: int, held_bytes: int = 64 << 20, grouped: bool = False) -> DataFrame:
    """kind, a, b, line_no, data: places (document, hash of the line, number), candidate pairs (hashes) and blocks of hot segments (key, block).

    grouped: members of groups (group, hash) take the place of pairs.
    """
    heavy_rows = 4 * block_rows

    def rows(kind, a, b, line=None, data=None):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b), pa.nulls(n, pa.int32()) if line is None else pa.array(line), pa.nulls(n, pa.binary()) if data is None else pa.array(data, pa.binary())],
            names=["kind", "a", "b", "line_no", "data"],
        )

    def joined(batches):
        held: dict[int, np.ndarray] = {INDEX: np.zeros(0, KEYS), PROBE: np.zeros(0, KEYS)}
        fresh: dict[int, list[np.ndarray]] = {INDEX: [], PROBE: []}
        hot_keys, numbers = np.zeros(0, np.uint64), {}
        size, limit = 0, held_bytes

        def blocks(kind, own):
            """The rows of one key, as blocks of it."""
            key = own["key"][0]
            for at in range(0, len(own), block_rows):
                number = numbers[kind, int(key)] = numbers.get((kind, int(key)), -1) + 1
                yield rows(kind, np.array([key]).view(np.int64), np.array([number]), data=[own[at : at + block_rows].tobytes()])

        def let_out(least: int):
            """Merges what came; rows of hot keys leave once there are `least` of a key. New hot keys are those of more than heavy_rows rows."""
            nonlocal hot_keys, size
            for kind in (INDEX, PROBE):
                held[kind] = once(np.concatenate([held[kind], *fresh[kind]]))
                fresh[kind] = []
                keys, n = np.unique(held[kind]["key"], return_counts=True)
                hot_keys = np.union1d(hot_keys, keys[n > heavy_rows])
            for kind in (INDEX, PROBE):
                keys, first, n = np.unique(held[kind]["key"], return_index=True, return_counts=True)
                out = np.isin(keys, hot_keys) & (n >= least)
                for at, count in zip(first[out].tolist(), n[out].tolist(), strict=True):
                    yield from blocks(kind, held[kind][at : at + count])
                held[kind] = held[kind][~np.repeat(out, n)]
            size = sum(x.nbytes for x in held.values())

        for batch in batches:
            for kind, data in zip(batch["kind"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if kind == OCCURRENCE:
                    places = np.frombuffer(data, PLACES)
                    yield rows(OCCURRENCE, np.ascontiguousarray(places["doc_id"]), np.ascontiguousarray(places["id"]), np.ascontiguousarray(places["line_no"]))
                    continue
                fresh[kind].append(np.frombuffer(data, KEYS))
                size += len(data)
                if size > limit:
                    yield from let_out(block_rows)
                    # a range of many keys that are not hot stays, and is not gone through again for little
                    limit = max(held_bytes, 2 * size)
        yield from let_out(1)
        index, probe = held.pop(INDEX), held.pop(PROBE)
        lo, hi = np.searchsorted(index["key"], probe["key"], "left"), np.searchsorted(index["key"], probe["key"], "right")
        some = hi > lo
        probe, lo, hi = probe[some], lo[some], hi[some]
        _, first, n = np.unique(probe["key"], return_index=True, return_counts=True)
        crowded = (hi - lo)[first] * n > hot
        for at, count in zip(first[crowded].tolist(), n[crowded].tolist(), strict=True):
            for kind, own in ((INDEX, index[lo[at] : hi[at]]), (PROBE, probe[at : at + count])):
                yield from blocks(kind, own)
        cool = ~np.repeat(crowded, n)
        if grouped:
            groups, ids = members(probe[cool], lo[cool], hi[cool], index, threshold)
            yield rows(MEMBER, groups.view(np.int64), ids)
            return
        for pairs in matches(probe[cool], lo[cool], hi[cool], index, threshold):
            if len(pairs):
                yield rows(PAIR, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

    return packed.mapInArrow(joined, "kind int, a long, b long, line_no int, data binary")


def hot_pairs(found: DataFrame, threshold: int, grouped: bool = False) -> DataFrame:
    """a, b: candidate pairs, or members of groups, of the segments that many lines share, one pair of blocks a row."""
    side = lambda kind, name: found.where(F.col("kind") == kind).select(F.col("a").alias("key"), F.col("data").alias(name))
    pairs = spread_join(side(PROBE, "probe"), side(INDEX, "index"), ["key"])

    def compared(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                probe, index = (np.frombuffer(batch[c][i].as_py(), KEYS) for c in ("probe", "index"))
                all_of = probe, np.zeros(len(probe), np.int64), np.full(len(probe), len(index)), index, threshold
                if grouped:
                    # each pair of blocks is a group of its own
                    groups, ids = members(*all_of)
                    made = [(W.mix(groups + np.uint64(batch["at"][i].as_py() % (1 << 64))).view(np.int64), ids)]
                else:
                    made = ((np.ascontiguousarray(p[:, 0]), np.ascontiguousarray(p[:, 1])) for p in matches(*all_of))
                for a, b in made:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # pairs of blocks are dealt to tasks one by one
    at = F.xxhash64("probe", "index")
    return pairs.select("probe", "index", at.alias("at")).repartition("at").mapInArrow(compared, "a long, b long")


def find(docs: DataFrame, threshold: int, min_chars: int, hot: int, block_rows: int, id_col: str, text_col: str, grouped: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, line_no, id of every line that takes part; a, b: candidate pairs, each once, or group and id of members)."""
    texts, spark = _texts(docs, id_col, text_col), docs.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // RANGE_BYTES))
    packed = packed_rows(texts, threshold, min_chars, ranges)
    found = cut(found_rows(packed.repartitionById(ranges, F.col("range")), threshold, hot, block_rows, grouped=grouped))
    every = found.where(F.col("kind") == OCCURRENCE).select(F.col("a").alias("doc_id"), "line_no", F.col("b").alias("id"))
    if grouped:
        return every, found.where(F.col("kind") == MEMBER).select(F.col("a").alias("group"), F.col("b").alias("id")).unionByName(hot_pairs(found, threshold, True).toDF("group", "id"))
    pairs = found.where(F.col("kind") == PAIR).select("a", "b").unionByName(hot_pairs(found, threshold)).distinct()
    return every, cut(pairs)


def place_hash(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(doc.astype(np.int64).view(np.uint64)) + line.astype(np.uint64))


def lines_at(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line of the lines at the places (doc_id, line_no), and of few others."""
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * places.count()).bit_length()))

    def marked(batches):
        bits = np.zeros(n_bits // 64, np.uint64)
        for batch in batches:
            at = place_hash(batch["doc_id"].to_numpy(), batch["line_no"].to_numpy()) % np.uint64(n_bits)
            np.bitwise_or.at(bits, (at // np.uint64(64)).astype(np.int64), np.uint64(1) << (at % np.uint64(64)))
        word = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits[word].view(np.int64))], names=["word", "bits"])

    made = places.select("doc_id", "line_no").mapInArrow(marked, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(n_bits // 64, np.uint64)
    words[made["word"].to_numpy()] = made["bits"].to_numpy().astype(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def found(batches):
        bits = shared.value
        for part in parts(batches):
            texts = part["text"].to_pylist()
            n = np.array([t.count("\n") + 1 for t in texts], np.int64)
            before = np.cumsum(n) - n
            line = np.arange(n.sum()) - np.repeat(before, n)
            at = place_hash(np.repeat(part["doc_id"].to_numpy(), n), line) % np.uint64(n_bits)
            hit = np.flatnonzero((bits[(at // np.uint64(64)).astype(np.int64)] >> (at % np.uint64(64))) & np.uint64(1))
            wanted: dict[int, list[int]] = {}
            for i, number in zip((np.searchsorted(before, hit, "right") - 1).tolist(), line[hit].tolist(), strict=True):
                wanted.setdefault(i, []).append(number)
            lines = []
            for i, numbers in wanted.items():
                own = texts[i].lower().split("\n")
                lines += [" ".join(own[j].split()) for j in numbers if j < len(own)]
            lines = sorted({x for x in lines if x})
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(Lines(lines).ids().view(np.int64)), pa.array(lines, pa.string())], names=["id", "line"])

    return _texts(docs, id_col, text_col).mapInArrow(found, "id long, line string").groupBy("id").agg(F.min("line").alias("line"))


def verified(pairs: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """a, b, distance: the pairs whose lines are within the threshold."""
    both = spread_join(spread_join(pairs, lines.toDF("a", "line_a"), ["a"]), lines.toDF("b", "line_b"), ["b"])

    def compared(batches):
        for batch in batches:
            found = [within(x, y, threshold) for x, y in zip(batch["line_a"].to_pylist(), batch["line_b"].to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(found, pa.int32())], names=["a", "b", "distance"])
            yield out.filter(pa.array([d <= threshold for d in found], pa.bool_()))

    return both.select("a", "b", "line_a", "line_b").mapInArrow(compared, "a long, b long, distance int")


def firsts_of(own: DataFrame, ids: DataFrame) -> DataFrame:
    """id, doc_id, line_no: where the lines of these ids stand first."""
    return cut(own.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("first")).select("id", "first.*"))


def links(docs: DataFrame, threshold: int = 2, min_chars: int = 30, hot: int = 1 << 26, block_rows: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, distance: pairs of different lines (hashes) within the threshold, each once."""
    every, pairs = find(docs, threshold, min_chars, hot, block_rows, id_col, text_col)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    lines = cut(lines_at(docs, firsts_of(every, ends), id_col, text_col))
    return cut(verified(pairs, lines, threshold))


def linked(dealt: DataFrame, threshold: int) -> DataFrame:
    """id, n_links, doc_id, line_no: per member of a group that has any, its links that count there and the earliest place of them.

    dealt: group, id, line, doc_id, line_no (the line's first place), groups (all of the line's); the rows of a group follow each other.
    """

    def pairs_of(rows):
        sketch, letters = np.array([r[-2] for r in rows], np.uint64), np.array([r[-1] for r in rows], np.uint64)
        size = np.array([len(r[2]) for r in rows], np.int64)
        step = max(1, (1 << 19) // len(rows))
        for lo in range(0, len(rows), step):
            at = slice(lo, lo + step)
            close = (np.bitwise_count(sketch[at, None] ^ sketch) <= 4 * threshold) & (np.bitwise_count(letters[at, None] ^ letters) <= 2 * threshold)
            i, j = np.nonzero(close & (np.abs(size[at, None] - size) <= threshold))
            i += lo
            yield from zip(i[i < j].tolist(), j[i < j].tolist(), strict=True)

    def compared(rows):
        sets = [set(r[5]) for r in rows]
        found: dict[int, list] = {}
        for i, j in pairs_of(rows):
            if min(sets[i] & sets[j]) == rows[i][0] and within(rows[i][2], rows[j][2], threshold) <= threshold:
                for x, y in ((i, j), (j, i)):
                    n, other = found.get(x, (0, rows[y][3:5]))
                    found[x] = n + 1, min(other, rows[y][3:5])
        return [(rows[x][1], n, *other) for x, (n, other) in found.items()]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["id", "n_links", "doc_id", "line_no"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out = []
            for part in parts_of_size(batch, "line", BLOCK_CHARS):
                lines = Lines(part["line"].to_pylist())
                columns = [part[c].to_pylist() for c in ("group", "id", "line", "doc_id", "line_no", "groups")]
                for row in zip(*columns, lines.parity().tolist(), lines.letters().tolist(), strict=True):
                    if held and held[0][0] != row[0]:
                        out += compared(held)
                        held = []
                    held.append(row)
            yield batch_of(out)
        if held:
            yield batch_of(compared(held))

    return dealt.select("group", "id", "line", "doc_id", "line_no", "groups").mapInArrow(run, "id long, n_links long, doc_id long, line_no int")


def classes_and_ends(docs: DataFrame, threshold: int, min_chars: int, hot: int, block_rows: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every line's place; places of repeated and candidate lines; id, n_links, other: lines within the threshold of different ones, how many, and the earliest place of these)."""
    every, found = find(docs, threshold, min_chars, hot, block_rows, id_col, text_col, grouped=True)
    groups = cut(found.groupBy("id").agg(F.collect_set("group").alias("groups")))
    again = every.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    own = cut(spread_join(every, small_side(again.unionByName(groups.select("id")).distinct()), ["id"]))
    firsts = firsts_of(own, groups.select("id"))
    lines = lines_at(docs, firsts, id_col, text_col).join(firsts, "id").join(groups, "id")
    dealt = lines.select(F.explode("groups").alias("group"), "*").repartition("group").sortWithinPartitions("group")
    ends = linked(dealt, threshold).groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min(F.struct("doc_id", "line_no")).alias("other"))
    return every, own, cut(ends)


def within(a: str, b: str, threshold: int) -> int:
    """Edit distance of a and b by banded bit-parallel columns; threshold + 1 if it is larger.

    Bit d of a column stands for row j - threshold + d, so a column is 2 * threshold + 1 bits wide.
    """
    if abs(len(a) - len(b)) > threshold:
        return threshold + 1
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return max(len(a), len(b))
    width = 2 * threshold + 1
    mask = (1 << width) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << (i + threshold)
    # reach[e]: diagonals d on which row j - threshold + d of a is reached with e edits after column j of b
    reach = [sum(1 << (threshold + d) for d in range(e + 1)) & mask for e in range(threshold + 1)]
    top = len(a)
    for j, c in enumerate(b):
        same = (at.get(c, 0) >> j) & mask
        rows = mask
        if j + 1 < threshold:
            rows &= ~((1 << (threshold - j - 1)) - 1)
        if j + 1 + threshold > top:
            rows &= (1 << max(0, top - j - 1 + threshold + 1)) - 1
        old, reach = reach, []
        for e in range(threshold + 1):
            now = old[e] & same
            if e:
                before = old[e - 1]
                now |= before | (before >> 1) | (reach[e - 1] << 1)
            reach.append(now & rows)
        if not reach[threshold]:
            return threshold + 1
    goal = 1 << (top - len(b) + threshold)
    return next((e for e in range(threshold + 1) if reach[e] & goal), threshold + 1)


def marks_of(own: DataFrame, ends: DataFrame) -> DataFrame:
    """doc_id, line_no, removed, n_links, first_doc_id: every line that is removed or has links to different lines.

    first_doc_id: where the line, or the earliest line within the threshold, stands first.
    """
    classes = own.groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    marked = classes.join(ends, "id", "left").where("n > 1 or n_links is not null")
    marked = marked.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.least("first", "other").alias("earliest"))
    here = F.struct("doc_id", "line_no")
    marks = spread_join(own, marked, ["id"])
    return marks.select("doc_id", "line_no", (here > F.col("earliest")).alias("removed"), "n_links", F.col("earliest.doc_id").alias("first_doc_id")).where("removed or n_links > 0")


def line_marks(docs: DataFrame, threshold: int = 2, min_chars: int = 30, hot: int = 1 << 26, block_rows: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As marks_of, for the lines of docs."""
    _, own, ends = classes_and_ends(docs, threshold, min_chars, hot, block_rows, id_col, text_col)
    return marks_of(own, ends)


def document_lines(docs: DataFrame, threshold: int = 2, min_chars: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, n_links, first_doc_ids (sorted ids where removed lines stand first).

    n_lines counts the lines that take part. Rows that repeat an id each report the figures of the id.
    """
    every, own, ends = classes_and_ends(docs, threshold, min_chars, 1 << 26, 8192, id_col, text_col)
    marks = marks_of(own, ends)
    per = marks.groupBy("doc_id").agg(F.count_if("removed").alias("n_removed"), F.sum("n_links").alias("n_links"), F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("first_doc_id")))).alias("first_doc_ids"))
    sizes = every.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id")).join(sizes, "doc_id", "left").join(per, "doc_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", count("n_lines"), count("n_removed"), count("n_links"), F.coalesce("first_doc_ids", F.array().cast("array<bigint>")).alias("first_doc_ids"))


def remove_lines(docs: DataFrame, threshold: int = 2, min_chars: int = 30, drop_emptied: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the removed lines in their texts; all rows and columns stay.

    With drop_emptied, rows that lose all of their text go: every line of theirs stands in another document.
    """
    gone = line_marks(docs, threshold, min_chars, id_col=id_col, text_col=text_col).where("removed").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    gone = small_side(gone, F.size("gone") + 1)
    # as one struct, so that no column of docs can clash with ours
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"))
    both = rows.join(gone, F.col(f"row.{id_col}") == F.col("doc_id"), "left")
    lines = F.filter(F.split(f"row.{text_col}", "\n"), lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col(f"row.{text_col}")).otherwise(F.array_join(lines, "\n"))
    if drop_emptied:
        both = both.where(F.col("gone").isNull() | F.regexp_like(text, F.lit(r"\S")))
    return both.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
