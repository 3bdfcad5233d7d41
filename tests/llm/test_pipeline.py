"""The pipeline against plain versions of its stages, and on odd rows and empty tables."""

import collections
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_brute import WORD, LOWER, components_of, distance, edited

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, documents, labels, benchmark):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in documents], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def without_repeats(rows):
    """Line dedup by comparing every line with every other one."""
    first, lines = {}, {}
    for i, text in rows:
        lines[i] = [(" ".join(x.lower().split()), x) for x in (text or "").split("\n")]
        for j, (line, _) in enumerate(lines[i]):
            if line:
                first.setdefault(line, (i, j))
    near = {x: [first[y] for y in first if x != y and min(len(x), len(y)) >= 30 and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2] for x in first}
    out = []
    for i, text in rows:
        kept = [raw for j, (line, raw) in enumerate(lines[i]) if not line or min([first[line], *near[line]]) >= (i, j)]
        if len(kept) == len(lines[i]):
            out.append((i, text))
        elif "".join(kept).strip():
            out.append((i, "\n".join(kept)))
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = sentence(14)
    rows = []
    for i in range(90):
        lines = [sentence(rng.randint(8, 14)) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            lines += ["you rotten vile scoundrel " + sentence(2)]
        if i % 10 == 1:
            lines += [item]
        if i % 7 == 2:
            lines += [edited(rng, rows[i - 2][1].split("\n")[0], 1)]
        if i % 11 == 3:
            lines = rows[i - 1][1].split("\n")
        if i % 13 == 4:
            lines = [rows[i - 3][1].replace("\n", " ")]
        rows.append((i, "\n".join(lines)))
    toxic = {i: int("scoundrel" in t) for i, t in rows}
    sf = folder(spark, tmp_path, rows, [(i, 0, y) for i, y in toxic.items()], [(1, item)])
    got = collections.defaultdict(dict)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]][r["start"]] = np.frombuffer(r["token_ids"], "<u4").tolist()
    left = without_repeats([(i, t) for i, t in rows if not toxic[i]])
    kept = {i for i, (_, _, own) in components_of(left, 5).items() if own}
    w = lambda t: WORD.findall(t.translate(LOWER))
    windows = {tuple(w(item)[j : j + 10]) for j in range(5)}
    left = [(i, t) for i, t in left if i in kept and not any(tuple(w(t)[j : j + 10]) in windows for j in range(len(w(t)) - 9))]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in got.items()} == {i: [*whole.encode(t, add_special_tokens=False).ids, 1] for i, t in left}
    assert 20 < len(left) < 60


def test_pipeline_on_odd_rows_and_empty_tables(spark, tmp_path):
    rows = [(1, None), (2, ""), (2, "one two three"), (None, "no id"), (None, None), (3, "x\n" * 3000), (3, "x\n" * 3000), (4, "word " * 30_000)]
    sf = folder(spark, tmp_path / "odd", rows, [(2, None, None), (None, 1, 1), (4, 0, 0)], [(1, None), (None, "x"), (2, "")])
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert {1, 2, 3, 4, None} == ids
    sf = folder(spark, tmp_path / "empty", [], [], [])
    assert corpus_pipeline.run(spark, sf).collect() == []
