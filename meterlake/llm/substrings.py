"""Removal of repeated passages by unit hashing.

Units are normalised to lower-case words and hashed, digests are grouped over all documents, the
earliest occurrence (smallest document id, then place) is kept, and every other one is removed;
its offsets in the original text are retained.

A unit is a whole line, however short, or a paragraph: lines that no line without words parts. Both
go by their words alone, so a paragraph is found in another wrapping too. A passage that stands
within lines, between other words, has no line of its own, so runs of `unit_words` words are units
too, wherever the hash of one is smallest among the next `unit_words` + 1: such places depend on the
words alone, so that any 2 * unit_words words which two documents share hold a unit at the same
place. With the default 25, every shared passage of 50 words or more is found, and within lines
nothing shorter than 25 words is.

The ends of a passage may lie up to `unit_words` words beyond its outermost unit, and a word between
two units may be in neither. So each unit of at least `unit_words` words next to words that no such
unit covers is extended over them, as far as they equal the words beside the kept occurrence.

Defined results: null and empty texts, and lines without words, have no units; rows with a null id take no part, and stay as
they are in remove_repeats. Within one document, later repeats that
do not overlap the kept one are removed too. Rows that
repeat an id count as one document; each is cut at its own units. Ids are read as 64-bit numbers. Other columns are kept by
remove_repeats.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meterlake.llm import words as W
from meterlake.llm.tasks import columns_of, cut, in_small_batches, parts, spread_join

UNITS = "doc_id long, digest long, start long, stop long, first_word long, n_words long, whole int"


def text_units(texts: list[str | None], unit_words: int):
    """(text number, digest, start, stop, first word, words, is it a line or paragraph) arrays per block; start and stop count code points."""
    for b in W.blocks(texts, W.ALNUM):
        if not len(b.hashes):
            continue
        left, sums = W.left_in_text(b.bounds), W.gram_sums(b.hashes)
        at, digest = W.winnow(b.hashes, left, unit_words, unit_words + 1)
        size = np.full(len(at), unit_words)
        breaks = np.flatnonzero(b.data == 10)
        line = np.searchsorted(breaks, b.starts)
        first = np.flatnonzero(np.diff(line, prepend=-1))
        last = np.append(first[1:], len(line))
        # paragraphs of several lines; a paragraph of one line is that line
        apart = (np.diff(line[first]) > 1) | np.isin(first[1:], b.bounds)
        lead = np.flatnonzero(np.concatenate([[True], apart]))
        end = np.append(lead[1:], len(first))
        several = end - lead > 1
        first, last = np.concatenate([first, first[lead[several]]]), np.concatenate([last, last[end[several] - 1]])
        whole = W.mix((sums[last] - sums[first]) * W.powers(W._GRAM_INV, len(sums))[first] + (last - first).astype(np.uint64))
        kind = np.repeat(np.array([0, 1], np.int32), [len(at), len(first)])
        at, digest, size = np.concatenate([at, first]), np.concatenate([digest, whole]), np.concatenate([size, last - first])
        text = np.searchsorted(b.bounds, at, "right") - 1
        points = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])
        origin = points[b.text_starts[text]]
        yield b.first + text, digest.view(np.int64), points[b.starts[at]] - origin, points[b.ends[at + size - 1]] - origin, at - b.bounds[text], size, kind


def units(docs: DataFrame, unit_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, start, stop, first_word, n_words: every unit of every document."""

    def found(batches):
        for batch in parts(batches):
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for text, *columns in text_units(batch["text"].to_pylist(), unit_words):
                yield pa.RecordBatch.from_arrays([pa.array(ids[text]), *map(pa.array, columns)], names=["doc_id", "digest", "start", "stop", "first_word", "n_words", "whole"])

    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(found, UNITS)


def repeats(docs: DataFrame, unit_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per removed passage: doc_id, start, stop (code points of the text), first_word, last_word, n_units, n_whole, first_doc_id, method.

    Units that touch or overlap are one passage; n_whole of its units are lines or paragraphs, the others runs (method: lines, runs or both); first_doc_id is the smallest document that keeps one of them.
    """
    every = units(docs, unit_words, id_col, text_col)
    keep = every.groupBy("digest").agg(F.min(F.struct("doc_id", "start", "stop", "first_word")).alias("keep"), F.count("*").alias("n")).where("n > 1")
    again = spread_join(every, keep, ["digest"]).where("doc_id <> keep.doc_id or start >= keep.stop")
    again = cut(again.groupBy("doc_id", "start", "stop", "first_word", "n_words").agg(F.min(F.struct("keep.doc_id", "keep.first_word", "digest")).alias("keep"), F.max("whole").alias("whole")))
    found = again.select("doc_id", "first_word", (F.col("first_word") + F.col("n_words")).alias("end_word"), "start", "stop", F.col("keep.doc_id").alias("keep_id"), F.lit(1).cast("long").alias("units"), F.col("whole").cast("long").alias("whole"))
    found = found.unionByName(extensions(again, docs, unit_words, id_col, text_col).withColumn("whole", F.lit(0).cast("long")))
    method = F.when(F.col("n_whole") == 0, "runs").when(F.col("n_whole") == F.col("n_units"), "lines").otherwise("both")
    return joined(found).withColumn("method", method)


def edges(again: DataFrame, unit_words: int) -> DataFrame:
    """doc_id, first_word, n_words, keep, side (-1 or 1): repeated units beside words that no unit of unit_words covers."""
    w = Window.partitionBy("doc_id").orderBy("first_word", "n_words")
    end = F.col("first_word") + F.col("n_words")
    before = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.coalesce(F.lead("first_word").over(w) > end, F.lit(True))
    sides = F.array(F.when(before < F.col("first_word"), -1), F.when(after & (before <= end), 1))
    long = again.where(F.col("n_words") >= unit_words).withColumn("sides", sides)
    return long.select("doc_id", "first_word", "n_words", "keep", F.explode(F.array_compact("sides")).alias("side"))


def beside(docs: DataFrame, places: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """The places with words (hashes of up to `most` words beyond the unit on its side, outwards), and at and bounds.

    places: doc_id, first_word, n_words, digest, side, keep_id, keep_first. at is where the unit ends on that side,
    bounds where each of the words does, in code points; both for places with a keep_id only.
    """
    names = ["first_word", "n_words", "digest", "side", "keep_id", "keep_first"]
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("places"))
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    kinds = {"doc_id": pa.int64(), "first_word": pa.int64(), "n_words": pa.int64(), "digest": pa.int64(), "side": pa.int32(), "keep_id": pa.int64(), "keep_first": pa.int64(), "words": pa.binary(), "at": pa.int64(), "bounds": pa.binary()}

    def found(batches):
        for batch in parts(batches):
            ids, asked, out = batch["doc_id"].to_pylist(), batch["places"].to_pylist(), []
            for b in W.blocks(batch["text"].to_pylist(), W.ALNUM):
                sums, inverse = W.gram_sums(b.hashes), W.powers(W._GRAM_INV, len(b.hashes) + 1)
                points = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])
                for i, (lo, hi, origin) in enumerate(zip(b.bounds[:-1].tolist(), b.bounds[1:].tolist(), points[b.text_starts].tolist(), strict=True)):
                    for x in asked[b.first + i]:
                        first, n = lo + x["first_word"], x["n_words"]
                        if first + n > hi:
                            continue
                        # rows that repeat an id may hold other texts
                        raw = (sums[first + n : first + n + 1] - sums[first : first + 1]) * inverse[first : first + 1]
                        if x["digest"] not in np.concatenate([W.mix(raw), W.mix(raw + np.uint64(n))]).view(np.int64):
                            continue
                        if x["side"] < 0:
                            near, ends, at = slice(max(lo, first - most), first), b.starts, b.starts[first]
                        else:
                            near, ends, at = slice(first + n, min(hi, first + n + most)), b.ends, b.ends[first + n - 1]
                        step, own = x["side"], x["keep_id"] is not None
                        out.append((ids[b.first + i], *(x[c] for c in names), b.hashes[near][::step].tobytes(), int(points[at]) - origin if own else None, (points[ends[near]][::step] - origin).astype(np.int32).tobytes() if own else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

    types = "doc_id long, first_word long, n_words long, digest long, side int, keep_id long, keep_first long, words binary, at long, bounds binary"
    return spread_join(rows, wanted, ["doc_id"]).mapInArrow(found, types)


def extensions(again: DataFrame, docs: DataFrame, unit_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, first_word, end_word, start, stop, keep_id, units (0): the words beside repeated units that repeat too."""
    own = cut(edges(again, unit_words).select("doc_id", "first_word", "n_words", "keep.digest", "side", F.col("keep.doc_id").alias("keep_id"), F.col("keep.first_word").alias("keep_first")))
    none = F.lit(None).cast("long")
    kept = own.select(F.col("keep_id").alias("doc_id"), F.col("keep_first").alias("first_word"), "n_words", "digest", "side", none.alias("keep_id"), none.alias("keep_first")).distinct()
    known = cut(beside(docs, own.unionByName(kept), unit_words, id_col, text_col))
    kept = known.where("keep_id is null").select(F.col("doc_id").alias("keep_id"), F.col("first_word").alias("keep_first"), "n_words", "digest", "side", F.col("words").alias("kept_words"))
    both = spread_join(known.where("keep_id is not null"), kept, ["keep_id", "keep_first", "n_words", "digest", "side"])

    def compared(batches):
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                a, b = np.frombuffer(x["words"], np.uint64), np.frombuffer(x["kept_words"], np.uint64)
                m = min(len(a), len(b))
                n = int(np.append(a[:m] != b[:m], True).argmax())
                first, end = x["first_word"], x["first_word"] + x["n_words"]
                if x["side"] < 0 and x["doc_id"] == x["keep_id"]:
                    n = min(n, first - x["keep_first"] - x["n_words"])
                if n > 0:
                    far = int(np.frombuffer(x["bounds"], np.int32)[n - 1])
                    place = (first - n, first, far, x["at"]) if x["side"] < 0 else (end, end + n, x["at"], far)
                    out.append((x["doc_id"], *place, x["keep_id"], 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "first_word", "end_word", "start", "stop", "keep_id", "units"])

    return both.mapInArrow(compared, "doc_id long, first_word long, end_word long, start long, stop long, keep_id long, units long")


def joined(found: DataFrame) -> DataFrame:
    """Units joined to passages where they touch or overlap: one order by document, and a group for each passage."""
    before = Window.partitionBy("doc_id").orderBy("first_word", "end_word").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce((F.col("first_word") > F.max("end_word").over(before)).cast("int"), F.lit(1))
    numbered = found.withColumn("__opened", opened)
    numbered = numbered.withColumn("__passage", F.sum("__opened").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    made = numbered.groupBy("doc_id", "__passage").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_word").alias("first_word"), (F.max("end_word") - 1).alias("last_word"), F.sum("units").alias("n_units"), F.sum("whole").alias("n_whole"), F.min("keep_id").alias("first_doc_id")
    )
    return made.drop("__passage")


def remove_repeats(docs: DataFrame, unit_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the passages cut from their texts; all columns and rows stay."""
    gone = repeats(docs, unit_words, id_col, text_col).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("gone"))
    # as one struct, so that no column of docs can clash with ours
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"))
    both = in_small_batches(rows.join(gone, F.col(f"row.{id_col}") == F.col("doc_id"), "left"))

    @F.pandas_udf("string")
    def without(text: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(text, gone, strict=True):
            at, kept = 0, []
            for x in spans if t is not None and spans is not None else ():
                kept.append(t[at : x["start"]])
                at = x["stop"]
            out.append(t if t is None else "".join([*kept, t[at:]]))
        return pd.Series(out, dtype=object)

    text = F.col(f"row.{text_col}")
    # rows that lose nothing stay in the JVM
    kept = both.where("gone is null").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    cut_ = both.where("gone is not null").select(*(without(text, "gone").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    return kept.unionByName(cut_)
