"""The layouts as formats of spark.read: pruned files are never opened, parts of a file are whole lines."""

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from meterlake.sources import formats, readings as IN


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("layouts")
    for h in (1, 2, 3):
        (root / "c" / f"house_{h}").mkdir(parents=True)
        for c in (1, 2, 10):
            rows = [f"{1_300_000_000 + 7 * i} {h * 100 + c + i / 4}" for i in range(50 * h)]
            (root / "c" / f"house_{h}" / f"channel_{c}.dat").write_text("\n".join(rows) + ("\n" if c != 2 else ""))
        (root / "l" / f"house_{h}").mkdir(parents=True)
        (root / "l" / f"house_{h}" / "labels.dat").write_text("2 kettle\n1 dish_washer\n3 kettle\n")
        (root / "w" / f"house_{h}").mkdir(parents=True)
        wide = [f"2013-10-09 13:06:{i:02d},{i},{i * h},{'' if i % 3 else i},{i % 2}" for i in range(40)]
        (root / "w" / f"house_{h}" / "CLEAN.csv").write_text("\n".join(["Time,Unix,Fridge,Not Used,Issues", *wide]))
    (root / "c" / "_SUCCESS").write_text("no data")
    return str(root)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_channels(spark, folder):
    formats.register(spark)
    for split in (10**9, 700):
        found = spark.read.format("meter_channels").option("split_bytes", split).load(f"{folder}/c")
        assert rows(found) == rows(IN.channel_files(spark, f"{folder}/c/*"))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100, 10_000])
def test_parts_are_whole_lines(tmp_path, monkeypatch, size):
    for n, text in enumerate((b"a 1\nbb 22\n\nccc 333\n", b"a 1\nbb", b"\n\n", b"abcdefghijkl", b"")):
        (tmp_path / "f").write_bytes(text)
        for block in (2, 1 << 20):
            monkeypatch.setattr(formats, "BLOCK", block)
            made = [b"".join(formats.lines(str(tmp_path / "f"), at, at + size)) for at in range(0, len(text), size)]
            assert b"".join(made) == text and all(not m or m.endswith(b"\n") or m == text[len(text) - len(m) :] for m in made)


def test_filters_leave_files_out(spark, folder, tmp_path):
    reader = formats.ChannelReader({"path": f"{folder}/c"})
    rest = list(reader.pushFilters([EqualTo(("house",), 2), In(("channel",), (1, 10)), GreaterThan(("watts",), 3.0)]))
    assert [type(f) for f in rest] == [GreaterThan] and [(p.house, p.channel) for p in reader.partitions()] == [(2, 1), (2, 10)]
    contrary = formats.ChannelReader({"path": f"{folder}/c"})
    list(contrary.pushFilters([EqualTo(("house",), 2), EqualTo(("house",), 3)]))
    assert [p.paths for p in contrary.partitions()] == [[]]
    # a file that cannot be parsed shows that the plan never opens it
    import shutil

    shutil.copytree(f"{folder}/c", tmp_path / "c")
    (tmp_path / "c" / "house_3" / "channel_1.dat").write_text("this is no reading at all\n")
    formats.register(spark)
    every = spark.read.format("meter_channels").load(str(tmp_path / "c"))
    assert every.where("house = 2 and watts > 0").count() == 300 and every.where("house = 3 and channel in (2, 10)").count() == 300
    with pytest.raises(Exception, match="CSV|conversion|parse"):
        every.where("house = 3").collect()
    plan = every.where("house = 2")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (isnotnull" not in plan or "house#" not in plan.split("BatchScan")[0].split("Filter")[-1]


def test_labels_and_houses(spark, folder):
    formats.register(spark)
    labels = spark.read.format("meter_labels").load(f"{folder}/l")
    assert rows(labels) == rows(IN.channel_labels(spark, f"{folder}/l/*")) and labels.where("house = 1").count() == 2
    for split in (10**9, 700):
        wide = spark.read.format("meter_houses").option("split_bytes", split).load(f"{folder}/w")
        assert rows(wide) == rows(IN.wide_house(spark, f"{folder}/w").select("house", "ordinal", "ts", "issue", "watts"))
    assert spark.read.format("meter_houses").load(f"{folder}/w").where("house = 9").count() == 0
