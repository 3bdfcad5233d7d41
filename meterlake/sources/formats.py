"""The source layouts as formats of spark.read: `meter_channels`, `meter_labels` and `meter_houses`.

    register(spark)
    spark.read.format("meter_channels").load(path).where("house = 3 and channel in (1, 2)")

A reader lists the files below the path, takes house and channel from their names by patterns (options
`house` and `channel`), and drops whole files by the filters on these columns before any is opened. Each
file is one partition, or several of `split_bytes` where it is longer; label files are one a house. Rows come
as Arrow batches, parsed a block at a time. Paths go through Arrow's file systems, so they may be
local or of any store that Arrow knows. Names that begin with . or _ are no data.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from meterlake.sources.readings import RENAMED

BLOCK = 8 << 20


@dataclass
class Part(InputPartition):
    house: int | None
    channel: int | None
    paths: list[str]
    start: int = 0
    end: int | None = None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    # a plain path, or a URI; file:/x as Spark writes it is file:///x
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def lines(path: str, start: int, end: int | None) -> Iterator[bytes]:
    """Whole lines that begin in [start, end) of a file, in blocks."""
    store, name = opened(path)
    with store.open_input_file(name) as f:
        at = start
        if start:
            # a line that begins before start belongs to the part before, unless it begins just there
            f.seek(start - 1)
            before = f.read(1)
            while before and before != b"\n":
                block = f.read(BLOCK)
                cut = block.find(b"\n")
                at += len(block) if cut < 0 else cut + 1
                before = b"\n" if cut >= 0 or not block else b"x"
            f.seek(at)
        rest = b""
        while end is None or at < end:
            block = f.read(BLOCK if end is None else min(BLOCK, end - at))
            if not block:
                break
            at += len(block)
            cut = block.rfind(b"\n") + 1
            if cut:
                yield rest + block[:cut]
                rest = block[cut:]
            else:
                rest += block
        # the last line may end beyond
        while rest:
            block = f.read(1 << 16)
            cut = block.find(b"\n") + 1
            if not block or cut:
                yield rest + block[:cut] if block else rest
                break
            rest += block


def parsed(block: bytes, names: list[str], types: dict[str, pa.DataType], separator: str) -> pa.Table:
    return pcsv.read_csv(
        io.BytesIO(block),
        read_options=pcsv.ReadOptions(column_names=names, use_threads=False),
        parse_options=pcsv.ParseOptions(delimiter=separator),
        convert_options=pcsv.ConvertOptions(column_types=types, strings_can_be_null=True),
    )


class LayoutReader(DataSourceReader):
    """Lists files, prunes them by house and channel, reads them."""

    pruned_by = ("house", "channel")

    def __init__(self, options):
        self.path = options["path"]
        self.house = re.compile(options.get("house", r"house_?=?(\d+)"))
        self.channel = re.compile(options.get("channel", r"channel_?=?(\d+)"))
        self.split = int(options.get("split_bytes", 128 << 20))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for one in filters:
            if isinstance(one, (EqualTo, In)) and len(one.attribute) == 1 and one.attribute[0] in self.pruned_by:
                values = {one.value} if isinstance(one, EqualTo) else set(one.value)
                name = one.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield one

    def files(self) -> list[tuple[int | None, int | None, str, int]]:
        """(house, channel, path, bytes) of the files that the filters leave, in order of path."""
        store, name = opened(self.path)
        scheme = re.match(r"(file:/(?!/)|[a-z0-9]+://)", self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(name, recursive=True)) if store.get_file_info(name).type == fs.FileType.Directory else [store.get_file_info(name)]:
            below = info.path[len(name) :]
            if info.type != fs.FileType.File or not info.size or any(p.startswith((".", "_")) for p in below.split("/") if p):
                continue
            keys = [int(m[1]) if (m := pattern.search(info.path)) else None for pattern in (self.house, self.channel)]
            if all(k in self.wanted.get(n, {k}) for n, k in zip(self.pruned_by, keys, strict=False)):
                # an object store's names lack its scheme
                found.append((*keys, info.path if not scheme or scheme[1].startswith("file:") else scheme[1] + info.path, info.size))
        return sorted(found, key=lambda x: x[2])

    def partitions(self) -> list[Part]:
        found = [Part(h, c, [path], at, at + self.split) for h, c, path, size in self.files() for at in range(0, size, self.split)]
        # Spark reads once where there is no partition
        return found or [Part(None, None, [])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        for path in part.paths:
            for table in self.tables(path, part):
                yield from table.to_batches()


def constant(value: int | None, n: int) -> pa.Array:
    return pa.array([value], pa.int32()).take(pa.array([0] * n, pa.int32())) if n else pa.array([], pa.int32())


class ChannelReader(LayoutReader):
    def tables(self, path, part):
        for block in lines(path, part.start, part.end):
            rows = parsed(block, ["epoch", "watts"], {"epoch": pa.int64(), "watts": pa.float64()}, " ")
            ts = pc.multiply(rows["epoch"], 1_000_000).cast(pa.timestamp("us", tz="UTC"))
            keys = [constant(k, len(rows)) for k in (part.house, part.channel)]
            yield pa.table([*keys, ts, rows["watts"]], names=["house", "channel", "ts", "watts"])


class LabelReader(LayoutReader):
    """Of several channels with one name in a house the first counts."""

    pruned_by = ("house",)

    def partitions(self):
        own: dict = {}
        for house, _, path, _ in self.files():
            own.setdefault(house, []).append(path)
        return [Part(house, None, paths) for house, paths in own.items()] or [Part(None, None, [])]

    def read(self, part):
        first: dict[str, int] = {}
        for path in part.paths:
            for block in lines(path, 0, None):
                rows = parsed(block, ["channel", "name"], {"channel": pa.int32(), "name": pa.string()}, " ")
                for channel, name in zip(rows["channel"].to_pylist(), rows["name"].to_pylist(), strict=True):
                    name = RENAMED.get((name or "").strip(), (name or "").strip())
                    first[name] = min(first.get(name, channel), channel)
        yield pa.RecordBatch.from_arrays([constant(part.house, len(first)), pa.array(first.values(), pa.int32()), pa.array(first.keys(), pa.string())], names=["house", "channel", "appliance"])


class HouseReader(LayoutReader):
    """Wide files with a header; the columns other than Time, Unix and the issue column are numbered from 0."""

    pruned_by = ("house",)

    def __init__(self, options):
        super().__init__(options)
        self.issues = options.get("issues", "Issues")

    def tables(self, path, part):
        head = next(lines(path, 0, 1)).splitlines()[0]
        names = next(csv.reader([head.decode()]))
        values = [n for n in names if n not in ("Time", "Unix", self.issues)]
        types = {n: pa.float64() for n in values} | {"Time": pa.timestamp("us"), self.issues: pa.int32()}
        first = part.start == 0
        for block in lines(path, part.start, part.end):
            if first:
                block, first = block[len(head) :].lstrip(b"\r\n"), False
                if not block:
                    continue
            rows = parsed(block, names, types, ",")
            n = len(rows)
            ts = rows["Time"].cast(pa.timestamp("us", tz="UTC"))
            for i, name in enumerate(values):
                yield pa.table([constant(part.house, n), constant(i, n), ts, rows[self.issues], rows[name]], names=["house", "ordinal", "ts", "issue", "watts"])


class _Layout(DataSource):
    def schema(self):
        return self.columns

    def reader(self, schema):
        return self.kind(self.options)


class Channels(_Layout):
    columns, kind = "house int, channel int, ts timestamp, watts double", ChannelReader

    @classmethod
    def name(cls):
        return "meter_channels"


class Labels(_Layout):
    columns, kind = "house int, channel int, appliance string", LabelReader

    @classmethod
    def name(cls):
        return "meter_labels"


class Houses(_Layout):
    columns, kind = "house int, ordinal int, ts timestamp, issue int, watts double", HouseReader

    @classmethod
    def name(cls):
        return "meter_houses"


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and turns on filter pushdown for formats written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for layout in (Channels, Labels, Houses):
        spark.dataSource.register(layout)
