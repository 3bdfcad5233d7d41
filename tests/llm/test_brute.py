"""Operators against plain brute-force versions on small tables."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterlake.llm import balltree, html, langid, licenses, linedup, neardup, packing, queries as Q, substrings, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in Q.table(spark, SF, "documents").collect()}


def test_license_base(spark):
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    found = {r["doc_id"]: r for r in Q.op1_license_scan(spark, SF).collect()}
    for doc, text in texts(spark).items():
        w = WORD.findall(text.translate(LOWER))
        places = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
        r = found[doc]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert {label for _, label in places} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def license_rows(text):
    """All columns of the query from plain regular expressions."""
    w = WORD.findall((text or "").translate(LOWER))
    line, starts = " ".join(w), {}
    at = 0
    for i, x in enumerate(w):
        starts[at] = i
        at += len(x) + 1
    found = []
    for order, r in enumerate(licenses.RULES):
        for m in re.finditer(f"(?<![^ ])(?:{r.pattern})(?![^ ])", line):
            first = starts[m.start()]
            found.append((first, -(first + m[0].count(" ")), -r.priority, order))
    kept = []
    for first, end, priority, order in sorted(found):
        if not any(-e >= -end and -p >= -priority for s, e, p, _ in kept):
            kept.append((first, end, priority, order))
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    base = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
    labels = {label for _, label in base} | {licenses.RULES[o].label for *_, o in kept}
    score = max([0.0, *(0.5 for _ in base), *(licenses.RULES[o].weight for *_, o in kept)])
    return len(w), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score, len(kept)


def test_license_query_against_plain_expressions(spark, tmp_path):
    rng = random.Random(17)
    sample = [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "GNU GENERAL PUBLIC LICENSE Version 2 or any later version", "SPDX-License-Identifier: GPL-3.0-or-later", "MIT License", "the mit licence", "under the terms of the MIT license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "isc license", "All rights reserved. Copyright (c) 2019-2021", "Creative Commons Attribution 4.0 International",
        "licensed under either the Apache License 2.0 or the MIT license", "mit dem Hund", "limit licenses", "this is free and unencumbered software released into the public domain",
    ]
    made = [(i, " ".join(rng.choice([*sample, "some other words,", "Ünicode K İ"]) for _ in range(rng.randint(0, 6)))) for i in range(300)]
    spark.createDataFrame([*made, (300, None), (301, "".join(sample) * 50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")
    for sf in (str(tmp_path), SF):
        rows = {r["doc_id"]: r["text"] for r in Q.table(spark, sf, "documents").collect()}
        for r in Q.op1_license_scan(spark, sf).collect():
            assert tuple(r[n] for n in names) == license_rows(rows[r["doc_id"]])


def written(parsed):
    """Strings that a parsed expression matches: every branch, and optional parts both left out and there once."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [next((chr(x) for o, x in arg if str(o) == "LITERAL" and str(arg[0][0]) != "NEGATE"), "7")]
        elif name == "NOT_LITERAL":
            more = ["x"]
        elif name in ("SUBPATTERN", "BRANCH"):
            more = [s for branch in ([arg[3]] if name == "SUBPATTERN" else arg[1]) for s in written(branch)]
        else:
            assert name == "MAX_REPEAT", name
            more = [s for n in {arg[0], max(arg[0], 1)} for s in ([""] if n == 0 else written(arg[2]))]
        out = [a + b for a in out for b in more]
    return out


def test_no_rule_matches_without_its_keywords():
    from re import _parser

    for r in licenses.RULES:
        assert all(k in s for s in written(_parser.parse(r.pattern)) for k in r.keywords), r


def test_license_suppression(spark):
    text = "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: GPL-3.0-or-later. Under the MIT license"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = licenses.scan(d).first()
    assert len(licenses.RULES) > 300
    assert {x["label"] for x in found["detections"]} == {"apache-2.0", "gpl-3.0-or-later", "mit"}
    for x in found["detections"]:
        assert not any(y != x and y["start"] <= x["start"] and y["end"] >= x["end"] and y["priority"] >= x["priority"] for y in found["detections"])


def test_packing_round_trip(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expect = {i: [*whole.encode(t, add_special_tokens=False).ids, 1] for i, t in texts(spark).items()}
    got = collections.defaultdict(dict)
    for r in packing.pack(Q.table(spark, SF, "documents"), Q.tokenizer_path()).collect():
        got[r["doc_id"]][r["start"]] = np.frombuffer(r["token_ids"], "<u4").tolist()
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in got.items()} == expect
    first = Q.op2_packing(spark, SF).first()
    ids = np.array(expect[first["doc_id"]][first["start"] : first["start"] + first["length"]], "<u4")
    assert zlib.crc32(ids.tobytes()) == first["ids_crc32"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_word_tokenizer_equals_the_tokenizer(text):
    own = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    whole = lambda t: own.whole.encode(t, add_special_tokens=False).ids
    texts = [text, "it's we'll ''s 'sort " + text, text + "'r\x85e're'd", None, text[::-1] + "<|endoftext|>'ve12"]
    assert [x.tolist() for x in own.encode(texts)] == [whole(t or "") for t in texts]


def test_tokenizer_of_another_kind():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = packing.WordTokenizer(path)
    assert not own.by_words and own.encode(["Two words", None])[0].tolist() == Tokenizer.from_file(path).encode("Two words", add_special_tokens=False).ids


def test_packing_keeps_ids(spark):
    d = spark.createDataFrame([(9007199254740993, "a b"), (None, "c"), (-(2**62) - 1, None)], "doc_id long, text string").coalesce(1)
    assert {(r["doc_id"], r["doc_tokens"]) for r in packing.pack(d, public_tokenizers.path("word_bpe_49k.json")).collect()} == {(9007199254740993, 3), (None, 2), (-(2**62) - 1, 1)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9000), max_size=40))
def test_balance_fills_every_sequence(lengths):
    used, pieces = collections.Counter(), collections.defaultdict(list)
    for doc, start, n, s, offset in packing.balance(lengths, 2048):
        assert offset == used[s]
        used[s] += n
        pieces[doc].append((start, n))
    assert all(n == 2048 or n & (n - 1) == 0 for n in used.values())
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(pieces[doc]):
            assert start == at
            at += size
        assert at == n


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 4))
def test_banded_distance(a, b, threshold):
    assert linedup.within(a, b, threshold) == min(distance(a, b), threshold + 1)


def edited(rng, line, n):
    chars = list(line)
    for _ in range(n):
        at = rng.randrange(len(chars))
        rng.choice([lambda: chars.insert(at, "q"), lambda: chars.pop(at), lambda: chars.__setitem__(at, "z")])()
    return "".join(chars)


def test_line_links(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(30, 60))).strip().ljust(30, "a") for _ in range(40)]
    lines = base + [edited(rng, b, rng.randint(1, 4)) for b in base for _ in range(3)]
    d = spark.createDataFrame([(i, "\n".join(lines[i::10])) for i in range(10)], "doc_id long, text string")
    lines = [" ".join(x.split()) for x in lines]
    names = dict(zip(linedup.Lines(lines).ids().view(np.int64).tolist(), lines, strict=True))
    found, hot = ({(frozenset((names[r["a"]], names[r["b"]])), r["distance"]) for r in linedup.links(d, 2, 30, **kw).collect()} for kw in ({}, {"hot": 2, "block_rows": 2}))
    distinct = sorted(x for x in names.values() if len(x) >= 30)
    expect = {(frozenset((a, b)), distance(a, b)) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    assert found == hot == expect and expect


def test_segment_that_many_lines_share(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("abcdefghij") for _ in range(20)) for _ in range(1000)]
    lines = [f"an opening which all of these lines have: {x}" for name in names for x in (name, edited(rng, name, 1))]
    d = spark.createDataFrame([(i, "\n".join(lines[i::50])) for i in range(50)], "doc_id long, text string")
    expect = {frozenset((a, b)) for a, b in zip(lines[::2], lines[1::2], strict=True) if a != b}
    by_id = dict(zip(linedup.Lines(lines).ids().view(np.int64).tolist(), lines, strict=True))
    for kw in ({}, {"hot": 1000, "block_rows": 100}):
        assert expect == {frozenset((by_id[r["a"]], by_id[r["b"]])) for r in linedup.links(d, **kw).collect()}


def test_hot_segments_leave_before_a_range_is_whole(spark):
    """Rows of one segment that come in many pieces: the same pairs, whether a task may hold all of them or hardly any."""
    rng = np.random.default_rng(5)
    n = 6000
    rows = np.zeros(n, linedup.KEYS)
    rows["key"] = np.where(rng.random(n) < 0.7, 7, rng.integers(100, 140, n))
    rows["id"], rows["sketch"] = rng.integers(0, 3000, n), rng.integers(0, 16, n) << 8
    pieces = [(0, int(rng.choice([linedup.INDEX, linedup.PROBE])), rows[i : i + 50].tobytes()) for i in range(0, n, 50)]
    packed = spark.createDataFrame(pieces, "range int, kind int, data binary").coalesce(1)

    def pairs(**kw):
        found = linedup.found_rows(packed, 2, 1 << 40, 128, **kw).cache()
        blocks = found.where(F.col("kind") == linedup.INDEX).select(F.max(F.octet_length("data")), F.count("*")).first()
        every = found.where(F.col("kind") == linedup.PAIR).select("a", "b").unionByName(linedup.hot_pairs(found, 2)).distinct()
        return sorted(map(tuple, every.collect())), blocks

    (whole, none), (small, some) = pairs(held_bytes=1 << 40), pairs(held_bytes=1 << 14)
    expect = set()
    of = lambda kind: np.concatenate([np.frombuffer(d, linedup.KEYS) for _, k, d in pieces if k == kind])
    index, probe = of(linedup.INDEX), of(linedup.PROBE)
    for key in np.unique(rows["key"]):
        a, b = linedup.once(probe[probe["key"] == key]), linedup.once(index[index["key"] == key])
        near = np.bitwise_count(a["sketch"][:, None] ^ b["sketch"][None, :]) <= 8
        expect |= {(min(x, y), max(x, y)) for x, y in zip(a["id"][np.nonzero(near)[0]].tolist(), b["id"][np.nonzero(near)[1]].tolist(), strict=True) if x != y}
    assert whole == small == sorted(expect)
    assert some[1] > none[1] and some[0] <= 128 * linedup.KEYS.itemsize


def test_document_lines(spark):
    rng = random.Random(8)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice([x, x.upper(), "  " + x, edited(rng, x, 1) or "x"]) for x in rng.choices(base, k=rng.randint(0, 8)))) for i in range(60)]
    first, places = {}, collections.defaultdict(list)
    for i, text in rows:
        for j, line in enumerate(text.split("\n")):
            line = " ".join(line.lower().split())
            if line:
                first.setdefault(line, (i, j))
                places[i].append((j, line))
    near = {x: [y for y in first if x != y and min(len(x), len(y)) >= 30 and distance(x, y) <= 2] for x in first}
    expect = {}
    for i, _ in rows:
        gone = [(x, min(first[y] for y in (x, *near[x]))) for j, x in places[i] if min(first[y] for y in (x, *near[x])) < (i, j)]
        expect[i] = (len(places[i]), len(gone), sum(len(near[x]) for _, x in places[i]), sorted({f[0] for _, f in gone}))
    found = linedup.document_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_links"], r["first_doc_ids"]) for r in found.collect()} == expect


def test_rows_of_a_group_of_near_lines(spark, monkeypatch):
    """Lines of one template with another short word, and lines that are all links of each other: no table has a row for each pair."""
    rng = random.Random(9)
    words = rng.sample(["".join(x) for x in itertools.product("bcdfghjk", repeat=3)], 300)
    template = [f"the same long opening of every line {w} and the same long end of it" for w in words]
    base = "another line that stands in many copies of which each has another letter changed somewhere" * 3
    near = [base[:i] + "#" + base[i + 1 :] for i in range(150)]
    lines = template + near
    close = {x: [y for y in lines if x != y and abs(len(x) - len(y)) <= 2 and linedup.within(x, y, 2) <= 2] for x in lines}
    rows, cut = [], linedup.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(linedup, "cut", counted)
    found = linedup.document_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_links"] for r in found} == {i: len(close[x]) for i, x in enumerate(lines)}
    assert all(len(close[x]) >= 149 for x in near) and max(rows) < 20 * len(lines)


def test_rows_of_a_group_of_near_lines_removed(spark, monkeypatch):
    """As the pipeline's stage removes them: one of many near lines stays, and no table has a row for each pair."""
    base = "one line that stands in many copies of which each has another letter changed somewhere" * 3
    lines = [base[:i] + "#" + base[i + 1 :] for i in range(200)]
    rows, cut = [], linedup.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(linedup, "cut", counted)
    found = linedup.remove_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), drop_emptied=True).collect()
    assert [tuple(r) for r in found] == [(0, lines[0])] and max(rows) < 20 * len(lines)


def test_tiles_of_a_group(spark):
    """Any two members of a group meet in some tile, and a pair that meets in several counts once."""
    rng = random.Random(10)
    base = "a line that stands in several copies of which some are near to each other"
    lines = sorted({edited(rng, base, rng.randint(0, 3)) for _ in range(40)})
    ids = np.arange(len(lines))
    for tile in (3, 7, 1000):
        groups, own = linedup.tiled(np.full(len(ids), 5, np.uint64), ids, tile)
        meet = {(a, b) for g in np.unique(groups) for a in own[groups == g] for b in own[groups == g] if a < b}
        assert len(meet) == len(lines) * (len(lines) - 1) // 2 and max(np.unique(groups, return_counts=True)[1]) <= max(2 * tile, len(lines) * (tile == 1000))
        of = {i: [int(g) for g in groups[own == i].view(np.int64)] for i in ids.tolist()}
        dealt = spark.createDataFrame([(g, i, lines[i], i, 0, of[i]) for i in of for g in of[i]], "group long, id long, line string, doc_id long, line_no int, groups array<long>")
        found = linedup.linked(dealt.repartition("group").sortWithinPartitions("group"), 2).groupBy("id").agg(F.sum("n_links").alias("n"), F.min("doc_id").alias("first"))
        close = {i: [j for j in of if i != j and distance(lines[i], lines[j]) <= 2] for i in of}
        assert {r["id"]: (r["n"], r["first"]) for r in found.collect()} == {i: (len(x), min(x)) for i, x in close.items() if x}


def test_lines_removed(spark):
    line = "this is a line of more than thirty characters"
    d = spark.createDataFrame([(1, f"{line}\nshort\n{line}"), (2, f"short\n{line.upper()}  \nkeep"), (3, f"{line}x"), (4, None)], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in linedup.remove_lines(d).collect()}
    assert kept == {1: f"{line}\nshort", 2: "keep", 3: "", 4: None}


def test_short_repeated_lines(spark):
    d = spark.createDataFrame([(1, "two words\none\ntwo  Words"), (2, "Two words\none\ntwo wordz")], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in linedup.remove_lines(d).collect()}
    assert kept == {1: "two words\none", 2: "two wordz"}
    assert {(r["doc_id"], r["n_lines"], r["n_removed"]) for r in linedup.document_lines(d).collect()} == {(1, 3, 1), (2, 3, 2)}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components_of(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def near_found(d, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(d, **kw).collect()}


def test_near_duplicates(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 80))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_found(d) == components_of(rows, 4)


def test_large_groups_of_near_copies(spark):
    rng = random.Random(11)
    rows = []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(200):
            copy = list(base)
            for at in rng.sample(range(120), rng.randint(1, 9)):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    expect = components_of(rows, 4)
    assert len({c for _, c, _ in expect.values()}) > 5
    # whole groups at once, and in small blocks behind the filter by rare shingles
    assert near_found(d) == near_found(d, block_rows=16) == expect


def template_pages(rng, n):
    """n pages of one template, alike by some 0.6, and near copies of every fiftieth."""
    common = [f"t{i}" for i in range(230)]
    rows = []
    for i in range(n):
        own = [f"p{i}w{j}" for j in range(75)]
        rows.append((len(rows), " ".join([*common, *own])))
        if i % 50 == 0:
            own[rng.randrange(75)] = "changed"
            rows.append((len(rows), " ".join([*common, *own])))
    return rows


def test_template_pages_are_not_compared_with_each_other(spark):
    rng, left = random.Random(12), []
    for n in (300, 1200):
        rows = template_pages(rng, n)
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        found = near_found(d, block_rows=32)
        assert {i: c for i, (_, c, _) in found.items()} == {i: i - 1 if "changed" in t else i for i, t in rows}
        # nobody has rare shingles in common with a page of another component
        sets = neardup.full_sets(d, d.select(F.col("doc_id").alias("id")), 4, "doc_id", "text")
        units = d.select(F.lit(0).cast("long").alias("unit"), F.col("doc_id").alias("id"), F.col("doc_id").alias("part"), (F.col("doc_id") > 0).alias("few"))
        kept = neardup.with_rare_partners(units, sets, 80, 32)
        left.append(kept.count())
        assert left[-1] == 2 * -(-n // 50)
    assert left[1] == 4 * left[0]


def test_rare_partners_lose_no_link(spark):
    rng = random.Random(15)
    for percent in (80, 60):
        rows, sets = [], {}
        for i in range(250):
            base = [rng.randrange(40) for _ in range(rng.randint(1, 30))]
            sets[i] = {zlib.crc32(f"{x}".encode()) for x in base}
            rows.append((i, np.array(sorted(sets[i]), np.uint64).tobytes()))
        held = spark.createDataFrame(rows, "id long, hashes binary")
        units = spark.createDataFrame([(0, i, i % 50, i % 50 > 0) for i in sets], "unit long, id long, part long, few boolean")
        kept = {r["id"] for r in neardup.with_rare_partners(units, held, percent, 3).collect()}
        linked = {i for a in sets for b in sets if a % 50 != b % 50 and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) for i in (a, b)}
        assert linked <= kept


def test_texts_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    d = spark.createDataFrame([(1, a), (2, b), (2, a + " more"), (3, b + " more"), (4, b)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(d).collect()) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 1)]


def test_links_away_from_every_center(spark):
    rng = random.Random(4)
    fresh = iter(range(10**9))
    base = [f"w{i}" for i in range(60)]

    def changed(n):
        own = list(base)
        for i in rng.sample(range(60), n):
            own[i] = f"v{next(fresh)}"
        return " ".join(own)

    # the smallest id of each bucket is one of many texts that are like neither of the last two
    rows = [(i, changed(15)) for i in range(200)] + [(200, " ".join(base)), (201, changed(4))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(d, k=1).collect()}
    assert found == {i: min(i, 200) for i in found}


def test_repeated_passages(spark):
    rng = random.Random(2)
    fresh = iter(range(10**9))
    filler = lambda n: " ".join(f"u{next(fresh)}" for _ in range(n))
    passage = filler(50)
    short = filler(24)
    data = [(1, filler(30) + " " + passage + " " + filler(9)), (2, filler(7) + " " + passage.upper() + ", " + filler(40)), (3, filler(200)), (4, filler(40) + " " + short), (5, short + " " + filler(40))]
    del rng
    d = spark.createDataFrame(data, "doc_id long, text string")
    found = substrings.repeats(d).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in found} == {(2, 1)}
    text = dict(data)[2]
    low, high = text.index(passage.upper()), text.index(passage.upper()) + len(passage)
    assert all(low <= r["start"] < r["stop"] <= high for r in found)
    kept = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(d).collect()}
    assert kept[3] == dict(data)[3] and len(kept[2]) < len(text)


def test_repeated_lines(spark):
    line = " ".join(f"word{i}" for i in range(26))
    d = spark.createDataFrame([(1, f"a b\n{line}\nc"), (2, f"{line}\nother")], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(d).collect()}
    assert kept == {1: f"a b\n{line}\nc", 2: "\nother"}


def test_short_lines_and_paragraphs(spark):
    data = [(1, "one two three\nalone\n\nnot here"), (2, "x y\nOne two, three!\nz\nalone"), (3, "k\n\none two\nthree alone\n\nlast")]
    d = spark.createDataFrame(data, "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(d).collect()}
    assert kept == {1: data[0][1], 2: "x y\n!\nz\n", 3: "k\n\n\n\nlast"}


def test_lines_and_paragraphs_against_plain_search(spark):
    rng = random.Random(14)
    pool = [" ".join(rng.choice("abcdefghijklmnopq") for _ in range(rng.randint(1, 5))) for _ in range(25)]
    data = [(i, "".join(rng.choice([rng.choice(pool), rng.choice(pool).upper() + "!", "", f"own{i}x{j}"]) + "\n" for j in range(rng.randint(0, 8)))) for i in range(50)]
    places = collections.defaultdict(list)
    for i, text in data:
        w = [(m[0].lower(), m.start(), m.end(), text.count("\n", 0, m.start())) for m in WORD.finditer(text.translate(LOWER))]
        lines = [[k for k in range(len(w)) if w[k][3] == n] for n in range(text.count("\n") + 1)]
        blocks, block = [], []
        for line in [*lines, []]:
            if line:
                block.append(line)
            else:
                blocks += [[k for x in block for k in x]] if len(block) > 1 else []
                block = []
        for unit in [x for x in lines if x] + blocks:
            places[tuple(w[k][0] for k in unit)].append((i, w[unit[0]][1], w[unit[-1]][2], unit[0], unit[-1]))
    gone = collections.defaultdict(dict)
    for found in places.values():
        keep = min(found)
        for i, start, stop, first, last in found:
            if i != keep[0] or start >= keep[2]:
                gone[i].update({k: None for k in range(first, last + 1)})
    expect = set()
    for i, words in gone.items():
        order = sorted(words)
        runs = [[order[0]]]
        for k in order[1:]:
            runs[-1].append(k) if k == runs[-1][-1] + 1 else runs.append([k])
        expect |= {(i, r[0], r[-1]) for r in runs}
    d = spark.createDataFrame(data, "doc_id long, text string")
    rows = substrings.repeats(d).collect()
    assert {(r["doc_id"], r["first_word"], r["last_word"]) for r in rows} == expect and len(expect) > 20
    assert all(r["n_whole"] == r["n_units"] > 0 for r in rows)


def test_whole_passages_are_covered(spark):
    rng = random.Random(3)
    fresh = iter(range(10**9))
    filler = lambda n: " ".join(f"ü{next(fresh)}" for _ in range(n))
    data, whole = [], {}
    for i in range(40):
        passage = filler(rng.randint(50, 120))
        if i % 3 == 0:
            passage = passage.replace(" ", "\n", 5)
        data.append((2 * i, filler(rng.randint(0, 60)) + ". " + passage + " - " + filler(rng.randint(0, 60))))
        before, after = filler(rng.randint(0, 60)) + "; ", " " + filler(rng.randint(0, 60))
        data.append((2 * i + 1, before + passage + after))
        whole[2 * i + 1] = [(len(before), len(before) + len(passage))]
    found = collections.defaultdict(list)
    for r in substrings.repeats(spark.createDataFrame(data, "doc_id long, text string")).collect():
        found[r["doc_id"]].append((r["start"], r["stop"]))
    assert found == whole


def test_balltree_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.integers(-3, 4, 6) / 4).tolist()) for i in range(400)]
    v = balltree.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in balltree.top_k(v, v.where("vec_id % 50 = 0"), 5, shard_rows=90, query_rows=3).collect()}
    m = np.floor(256 * np.array([r[1] for r in rows])).astype(int)
    for q in range(0, 400, 50):
        best = sorted((-int(m[q] @ m[i]), i) for i in range(400) if i != q)[:5]
        assert [found[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_balltree_with_clusters(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(0, 4, (12, 8))
    rows = [(int(i), (middle[0 if i % 3 == 0 else i % 12] + rng.normal(0, 0.2, 8)).tolist()) for i in range(600)]
    v = balltree.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in balltree.top_k(v, v.where("vec_id % 50 = 0"), 5, shard_rows=40, query_rows=4).collect()}
    m = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    for q in range(0, 600, 50):
        best = sorted((-int(m[q] @ m[i]), i) for i in range(600) if i != q)[:5]
        assert [found[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    # a query of one cluster does not go to all of them
    p = balltree.Pivots(m[:12].tolist())
    own, far = p.nearest(m.tolist())
    radii = np.array([far[own == i].max(initial=-1.0) for i in range(12)])
    assert len(p.reached(m[1].astype(float), radii, float(sorted(m @ m[1])[-6]))) < 6


def test_balltree_with_huge_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-9, 10, 5) * 10.0 ** rng.integers(0, 12, 5)).tolist()) for i in range(300)]
    table = spark.createDataFrame([*rows, (50, rows[50][1])], "vec_id long, embedding array<double>")
    v = balltree.whole_vectors(table)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in balltree.top_k(v, v.where("vec_id % 50 = 0"), 5, shard_rows=90, query_rows=3).collect()}
    m = [[int(np.floor(256 * x)) for x in r[1]] for r in rows] + [[int(np.floor(256 * x)) for x in rows[50][1]]]
    ids = [r[0] for r in rows] + [50]
    for q in range(0, 300, 50):
        best = sorted((-min(max(sum(a * b for a, b in zip(m[q], m[i], strict=True)), balltree.LOW), balltree.HIGH), ids[i]) for i in range(301) if ids[i] != q)[:5]
        assert [found[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    extreme = balltree.whole_vectors(spark.createDataFrame([(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [-1e200, 2.0])], "vec_id long, embedding array<double>"))
    assert [(r["vec_id"], r["score"]) for r in balltree.top_k(extreme, extreme.where("vec_id = 0"), 5).orderBy("rank").collect()] == [(1, balltree.HIGH), (2, balltree.LOW)]


def test_pages(spark):
    for r in Q.table(spark, SF, "pages").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"] or "", re.S)
        if body:
            inner = re.sub(r"<[^>]*\Z", "", re.sub(r"</?b>", "", body[1].replace("<br>", " ")))
            import html as H

            lines = [" ".join(H.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
            assert html.main_text(r["html"]) == "\n".join(x for x in lines if x)
    page = '<body><nav>m</nav><div class="cookie-notice">c</div><main><form>f</form><h2>Head</h2>text <i>more</i><aside>s</aside><script>1</script></main><div id="comments"><p>reader</p></div><footer>f</footer>'
    assert html.main_text(page) == "Head\ntext more"


def test_odd_pages():
    assert html.main_text("<p>one <![foo bar]> two<![ x]></p><![CDATA[z]]>") == "one two"
    assert html.main_text("<head><title>t</title><p>text") == "text" and html.main_text("<head>text<title>t</title> more") == "text\nmore"
    assert html.main_text("<body><form><p>all of it</p></form>") == "all of it"
    assert html.main_text("<body><form>f<main><p>main</p></main></form><p>out</p>") in ("main", "main\nout")
    article = '<article><h1>H</h1><p class="side-effects">effects of it</p><p id="related-work">work of others</p><div class="cookie-notice">c</div><div class="related-posts">r</div></article>'
    assert html.main_text(article) == "H\neffects of it\nwork of others"
    assert html.main_text("<div>" * 6000 + "x" + "</i>" * 6000) == "x"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "</", "<!", "<![", "]]>", "<!--", "-->", "&", "&#x110000;", "&#0;", "p", "div", "article", "head", "form", "script", "title", " ", "=", "\"", "class=ad", "text", "/>", "<p>", "</p>", "<li>", "<br>", "<td>", "\x00", "é"]), max_size=40))
def test_tag_soup(parts):
    assert isinstance(html.main_text("".join(parts)), str)


def test_choice_of_regions_without_article():
    rng = random.Random(3)
    for _ in range(40):
        blocks = [("".join(rng.choice("abc ") for _ in range(rng.choice([5, 300]))).strip() or "a") for _ in range(rng.randint(1, 9))]
        page = "".join(f"<div>{b}</div>" for b in blocks)
        lines = [" ".join(b.split()) for b in blocks]
        # a line's own start and end tag
        ratio = [len(b) / 2 for b in lines]
        weight = [np.exp(-d * d / 2) for d in range(3)]
        soft = [sum(ratio[j] * weight[abs(i - j)] for j in range(len(lines)) if abs(i - j) <= 2) / sum(weight[abs(i - j)] for j in range(len(lines)) if abs(i - j) <= 2) for i in range(len(lines))]
        votes = [len(b) if s >= np.std(soft) - 1e-9 else 0 for b, s in zip(lines, soft, strict=True)]
        assert html.main_text(page) == "\n".join(b for b, v in zip(lines, votes, strict=True) if v)


def test_toxicity_against_plain_counts(spark):
    rng = random.Random(13)
    common, rude = [f"c{i}" for i in range(60)], ["rude", "vile", "mean"]
    rows = []
    for i in range(120):
        words = rng.choices(common, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(0, 30)) + [f"r{rng.randrange(300)}" for _ in range(rng.randint(0, 4))]
        if i % 4 == 0:
            words += rng.choices(rude, k=2)
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_model(d, d.select("doc_id", "toxic"))
    first = {}
    for i, text, y in rows:
        first.setdefault(text, (i, y))
    counts = [collections.Counter(), collections.Counter()]
    near = collections.defaultdict(set)
    for text, (_, y) in first.items():
        w = text.split()
        counts[y].update(w)
        for a, b in zip(w, w[1:]):
            near[b].add(a)
    total = [sum(c.values()) for c in counts]
    seen = [[sum(v == k for v in c.values()) for k in (1, 2, 3, 4)] for c in counts]
    held = lambda c, y: min([0, *toxicity.discounts(*seen[y])][min(c, 3)], c)
    left = [sum(held(v, y) for v in counts[y].values()) / total[y] for y in (0, 1)]
    share = lambda w: (len(near[w]) + 0.5) / (sum(map(len, near.values())) + 0.5 * (1 << 20))

    def ratio(w, own=0, of=None):
        c = [counts[y][w] - (own if y == of else 0) for y in (0, 1)]
        p = [(c[y] - held(c[y], y)) / total[y] + left[y] * share(w) for y in (0, 1)]
        return np.log(p[1] / p[0])

    def evidence(text, of=None):
        n = collections.Counter(text.split())
        r = sorted((ratio(w, k, of), k) for w, k in n.items())
        return [r[-1][0], np.mean([x for x, _ in r[-3:]]), sum(x * k for x, k in r) / sum(n.values())] if r else [0, 0, 0]

    some = [t for t in first]
    assert np.allclose(model.evidence(some), [evidence(t) for t in some], atol=1e-4)
    labels = [first[t][1] for t in some]
    assert np.allclose(model.evidence(some, labels), [evidence(t, y) for t, y in zip(some, labels)], atol=1e-4)
    found = {r["doc_id"]: r["score"] for r in toxicity.score_texts(d, model).collect()}
    assert all(abs(found[i] - 1 / (1 + np.exp(-np.dot(model.weights, [1, *evidence(t)])))) < 1e-3 for i, t, _ in rows)
    assert np.mean([(found[i] >= 0.3) == y for i, _, y in rows]) > 0.9


def test_more_languages_than_bits(spark):
    rng = random.Random(7)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i}": ["".join(rng.choice(alphabet) for _ in range(5)) for _ in range(6)] for i in range(150)}
    rows = [(i * 10 + j, " ".join(rng.choices(w, k=12)), lang) for i, (lang, w) in enumerate(words.items()) for j in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(d, langid.train_filter(d)).collect()}
    assert np.mean([found[i] == lang for i, _, lang in rows]) > 0.98


def test_language_filter_against_counting(spark):
    rng = random.Random(12)
    rows = [(i, " ".join("".join(rng.choice("abcde" if i % 3 else "defgh") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 20))), f"l{i % 3}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    grams = lambda text: [g for w in text.split() for g in (f" {w} "[j : j + 3] for j in range(len(w)))]
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        counts[lang].update(grams(text))
    rate = {g: {x: c[g] / sum(c.values()) for x, c in counts.items() if c[g]} for c in counts.values() for g in c}
    # so many slots that the filter makes no mistakes worth correcting
    model = langid.train_filter(d, slots=1 << 22)
    for r in langid.identify(d, model).collect():
        own = grams(dict((i, t) for i, t, _ in rows)[r["doc_id"]])
        hits = {x: sum(rate[g].get(x, 0) >= 0.2 * max(rate[g].values()) for g in own) for x in counts}
        if own:
            assert r["lang_pred"] == min(hits, key=lambda x: (-hits[x], x)) and abs(r["score"] - max(hits.values()) / sum(hits.values())) < 1e-3
        else:
            assert r["lang_pred"] == "und"


def test_models_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in Q.table(spark, sf, "documents").collect()}
    found = [r for r in Q.op10_language_id(spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in found]) >= 0.97
    toxic = {r["doc_id"]: r["toxic"] for r in Q.table(spark, sf, "labels").collect()}
    found = [(r["score"], toxic[r["doc_id"]]) for r in Q.op4_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    on, off = [s for s, y in found if y], [s for s, y in found if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in on for b in off]) >= 0.85
