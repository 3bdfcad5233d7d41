"""Byte-level BPE, periodic runs and hard negatives: against libraries and brute-force versions, and on odd rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from meterlake.llm import bytebpe, negatives, periods, queries as Q

SF = "/root/testdata/sf0.001"
PATH = Q.ranks_path()
EXTRA = ", id string, token_ids int, `a.b` int, runs string, text_ string"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
TEXTS = [(1, None), (2, ""), (3, "  \n\n "), (4, "don't we'll 's"), (5, LONG), (5, LONG), (None, "no id"), (7, "é ß 漢字 \x00 x  y 😀'RE"), (8, "a" * 5000), (9, "x " * 4000)]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "x", 1, 2, "r", "t") for i, t in rows], "doc_id long, text string" + EXTRA)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


# --- byte-level BPE --------------------------------------------------------------------------------


def ranks():
    with open(PATH, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bytebpe.ByteBpe(f.read(), bytebpe.library_classes())


PIECES = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "B", "1", "²", "!", "é", "漢", " ", "\x85", "x́", "😀", "\x1c", "​", "don't", "''"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14), st.text(max_size=20))
def test_bpe_equals_the_library(library, own, parts, more):
    texts = ["".join(parts), more, None, "".join(parts[::-1]) + more]
    ids, offsets, counts = own.encode(texts)
    expect = [library.encode_ordinary(t or "") for t in texts]
    assert counts.tolist() == list(map(len, expect)) and ids.tolist() == [i for e in expect for i in e]
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert own.decode(ids[at : at + n], offsets[at : at + n]) == (t or "").encode()
        at += n


def test_classes_equal_the_library_for_every_code_point(own):
    """A code point before "a", "1" or "!" is in one match with it just where both are of one class."""
    for tail, kind in (("a", bytebpe.LETTER), ("1", bytebpe.NUMBER), ("!", bytebpe.OTHER)):
        pairs = {bytes([b]) + tail.encode(): 256 + b for b in range(256)}
        probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([b]): b for b in range(256)} | pairs, special_tokens={})
        for lo in range(0, 0x110000, 0x1000):
            asked = [c for c in range(lo, lo + 0x1000) if c not in (10, 32) and not 0xD800 <= c < 0xE000]
            if asked:
                ids = np.array(probe.encode_ordinary("".join(chr(c) + tail + "\n" for c in asked)))
                joined = ids[np.flatnonzero(ids == 10) - 1] >= 256
                assert np.array_equal(joined, own.table[asked] == kind)
    assert bytebpe.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=80))
def test_merging_many_pieces_equals_merging_one(own, piece):
    pieces = [piece, piece[::-1], piece + piece]
    expect = [bytebpe.merge(p, own.ranks) for p in pieces]
    assert [np.frombuffer(x, "<i4").tolist() for x in own.find(pieces)] == expect
    assert [np.frombuffer(x, "<i4").tolist() for x in own.find(pieces)] == expect


def test_bpe_of_long_texts(library, own, monkeypatch):
    rng = random.Random(4)
    some = "".join(rng.choice(["ab", " ", "  ", "\n", "'s", "é", "12", "!?", " x"]) for _ in range(20_000))
    expect = library.encode_ordinary(some)
    assert own.encode([some])[0].tolist() == expect
    cut = list(bytebpe.slices([some, "", some[:7]], 100))
    assert max(sum(len(t) for _, t in part) for part in cut) < 400 and "".join(t for part in cut for i, t in part if i == 0) == some
    monkeypatch.setattr(bytebpe.slices, "__defaults__", (100,))
    assert own.encode([some])[0].tolist() == expect
    for text in ("ab" * 20_000, "漢字" * 9000, "'s" * 9000, " " * 9000):
        assert own.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_bpe_cache_is_bounded(own, library):
    with open(PATH, "rb") as f:
        small = bytebpe.ByteBpe(f.read(), own.table.tobytes(), max_pieces=10)
    text = " ".join(f"w{i % 300}q" for i in range(900))
    assert small.encode([text])[0].tolist() == library.encode_ordinary(text)
    small.encode(["few"])
    assert len(small.pieces) <= 10


def test_bpe_query(spark, library):
    rows = {r["doc_id"]: r["text"] or "" for r in Q.table(spark, SF, "documents").collect()}
    found = Q.op11_byte_bpe(spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode_ordinary(rows[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(rows[r["doc_id"]]))


def test_bpe_of_odd_rows(spark):
    d = docs(spark)
    tokens = bytebpe.encode(d, PATH)
    found = bytebpe.decode(tokens, PATH).collect()
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in found) == sorted((str(i), t or "") for i, t in TEXTS)
    assert bytebpe.encode(docs(spark, []), PATH).collect() == []
    odd = spark.createDataFrame([(1, [-1], [0]), (2, [60_000], [0]), (3, None, None), (4, [None], [0]), (5, [], []), (6, [300, 65], [2, 0])], "doc_id long, token_ids array<int>, offsets array<long>")
    got = {r["doc_id"]: r["decoded"] for r in bytebpe.decode(odd, PATH).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [None] * 4 and got[5] == b"" and len(got[6]) >= 3


# --- periodic runs ---------------------------------------------------------------------------------


def brute_runs(w, powers=4, least=6):
    """(start, length, period) by trying every period at every place."""
    found = {}
    for q in range(1, len(w) // powers + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, powers * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic(rng):
    k, w = rng.choice([1, 2, 3, 8, 50]), []
    for _ in range(rng.randint(0, 5)):
        unit = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
        w += (unit * rng.randint(1, 9))[: rng.randint(3, 90)]
    return w


def test_runs_against_every_period_at_every_place():
    rng = random.Random(3)
    for _ in range(600):
        texts = [periodic(rng) for _ in range(rng.randint(0, 6))]
        powers, least = rng.choice([(4, 6), (3, 3), (5, 9)])
        got = [[] for _ in texts]
        for i, *r in zip(*periods.runs([np.array(t, np.int64) for t in texts], powers, least), strict=True):
            got[i].append(tuple(map(int, r)))
        assert got == [brute_runs(t, powers, least) for t in texts]


def test_extensions_through_the_grammar():
    rng = random.Random(8)
    for _ in range(300):
        w = periodic(rng) + periodic(rng)
        if len(w) < 2:
            continue
        s = np.array([1000, *w, 1001])
        a, b = rng.sample(range(1, len(w) + 1), 2)
        ahead = next(n for n in range(len(s)) if s[a + n] != s[b + n])
        behind = next(n for n in range(len(s)) if s[a - 1 - n] != s[b - 1 - n])
        found = periods.Grammar(np.unique(s, return_inverse=True)[1]).extend(np.array([a, a]), np.array([b, b]), np.array([0, 1]))
        assert found.tolist() == [ahead, behind]


def test_runs_of_slices(monkeypatch):
    rng = random.Random(5)
    texts = [np.array(periodic(rng), np.int64) for _ in range(40)]
    whole = [x.tolist() for x in periods.runs(texts)]
    monkeypatch.setattr(periods, "SLICE", 7)
    assert [x.tolist() for x in periods.runs(texts)] == whole and whole[0]


@pytest.mark.parametrize("words", [[1] * 40_000, [i % 2999 for i in range(60_000)], [bin(i).count("1") % 2 for i in range(40_000)]])
def test_long_runs(words):
    found = list(zip(*(x.tolist() for x in periods.runs([np.array(words)])), strict=True))
    q = {1: 1, 2999: 2999}.get(max(words) + 1 if max(words) > 1 else len(set(words)))
    assert found == ([(0, 0, len(words), q)] if q else [])


def planted(doc_id, text):
    w = [x for x in (text or "").encode().split() if x]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("made", [False, True])
def test_runs_query(spark, tmp_path, made):
    sf = SF
    if made:
        rng = random.Random(6)
        rows = [(i, " \n\t".join(f"w{x}" for x in periodic(rng))) for i in range(300)] + [(300, None), (301, ""), (302, " a a  a a  a a a a "), (303, "A a A a A a A a A a")]
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        sf = str(tmp_path)
    texts = {r["doc_id"]: r["text"] for r in Q.table(spark, sf, "documents").collect()}
    found = Q.op12_periodic_runs(spark, sf).collect()
    assert len(found) == len(texts) and any(r["n_runs"] for r in found)
    for r in found:
        w = planted(r["doc_id"], texts[r["doc_id"]])
        runs = brute_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        assert (r["n_words"], r["n_runs"]) == (len(w), len(runs))
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r["collapsed_sha256"] == sha(b" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs_of_odd_rows(spark):
    found = periods.find_runs(docs(spark)).collect()
    assert len(found) == len(TEXTS)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["n_words"] == by_id[2]["n_words"] == by_id[3]["n_words"] == 0 and by_id[1]["collapsed"] == ""
    assert [tuple(r) for r in by_id[9]["runs"]] == [(0, 4000, 1)] and by_id[9]["collapsed"] == "x"
    assert [tuple(r) for r in by_id[5]["runs"]] == [(0, 60_000, 997)] and by_id[5]["collapsed"] == " ".join(f"word{i}" for i in range(997))
    assert by_id[None]["runs"] == [] and periods.find_runs(docs(spark, [])).collect() == []


# --- hard negatives --------------------------------------------------------------------------------


def brute_negatives(rows, anchors, positives=5, negatives_=5):
    out = []
    one = {}
    for i, label, v in anchors:
        one[i] = min(one.get(i, (label, v)), (label, v))
    for a, (label, q) in one.items():
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, lab) for i, lab, v in rows if i != a and len(v) == len(q))
        own = [(s, i) for s, i, lab in scored if lab == label][:positives]
        for place, (s, p) in enumerate(own, 1):
            band = [(t, i) for t, i, lab in scored if lab != label and 80 * -s <= 100 * -t <= 100 * -s][:negatives_]
            out += [(a, p, place, r, i, -s, -t) for r, (t, i) in enumerate(band, 1)]
    return sorted(out)


NAMES = ("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")


def mined(spark, rows, anchors, **kw):
    d = spark.createDataFrame(rows, "id long, label long, v array<long>")
    a = spark.createDataFrame(anchors, "id long, label long, v array<long>")
    return sorted(tuple(r[n] for n in NAMES) for r in negatives.mine(d, a, **kw).collect())


@pytest.mark.parametrize("shape", ["clusters", "lengths", "ties", "large"])
def test_negatives_against_all_pairs(spark, shape):
    rng = np.random.default_rng(7)
    n, d = 500, 8
    centers = rng.normal(size=(6, d)) * 100
    v = centers[rng.integers(0, 6, n)] + rng.normal(size=(n, d)) * 20
    if shape == "lengths":
        v *= np.exp(rng.normal(size=(n, 1)) * 2)
    if shape == "ties":
        v = rng.integers(-1, 2, (n, d))
    if shape == "large":
        v *= 1_000_000
    labels = rng.integers(0, 4, n) if shape != "ties" else rng.integers(0, 40, n)
    rows = [(int(i), int(x), [int(y) for y in row]) for i, x, row in zip(rng.permutation(n), labels, v, strict=True)]
    rows += [rows[0], (1000, 1, [0] * d), (1001, 2, [5, 5]), (1002, 1, [5, 5]), (1003, 1, [5, 4])]
    anchors = rows[:40] + rows[-4:]
    expect = brute_negatives(rows, anchors)
    assert expect and mined(spark, rows, anchors, shard_rows=64, label_groups=3) == expect


def test_shards_prune_by_coordinates():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 16)) * 300
    v = (centers[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)) * 10).round().astype("<i8")
    unit, _ = negatives._unit(v)
    lists = np.ascontiguousarray(np.argsort(unit, axis=0, kind="stable").T.astype("<u4"))
    shard = negatives.Shard({"ids": np.arange(2000, dtype="<i8").tobytes(), "labels": np.zeros(2000, "<i8").tobytes(), "vectors": v.tobytes(), "lists": lists.tobytes()})
    for i in range(0, 2000, 100):
        q = v[i].astype(float)
        scores = v @ v[i]
        for floor in (0.9 * scores.max(), 0.5 * scores.max(), 1.0, 0.0, -1e4, scores.max(), scores.max() + 1):
            found = shard.candidates(q, floor, 8)
            assert set(np.flatnonzero(scores >= floor)) <= set(found.tolist())
        assert len(shard.candidates(q, 0.9 * scores.max(), 8)) < 400


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.95, 0.5], 2), (2, [0.95, 0.5], 2), (3, None, 1), (4, [], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0], 2), (None, [1.0, 1.0], 1), (9, [1.0, 0.5], None)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("id", F.lit("x"))
    v = negatives.labelled_vectors(table)
    assert sorted(r["id"] for r in v.collect()) == [0, 1, 2, 2, 8]
    found = sorted(tuple(r[n] for n in NAMES) for r in negatives.mine(v, v.where("id = 0")).collect())
    assert found == [(0, 1, 1, 1, 2, 81920, 78592), (0, 1, 1, 2, 2, 81920, 78592)]
    assert negatives.mine(v.limit(0), v.limit(0)).collect() == []
    assert negatives.mine(v, v.limit(0)).collect() == []


def test_negatives_query(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got, expect = Q.op13_hard_negatives(spark, SF).toPandas(), con.execute(Q.SQL["op13_hard_negatives"]).df()
    columns = sorted(expect.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, expect[columns].values.tolist())) and len(got)
