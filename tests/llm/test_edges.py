"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from meterlake.llm import balltree, decontaminate, html, langid, licenses, linedup, neardup, packing, substrings, toxicity

LONG = " ".join(f"word{i % 997}" for i in range(30_000))
TEXTS = [(1, None), (2, ""), (3, "   \n\n "), (4, "one two"), (5, LONG), (5, LONG), (6, "MIT License and more of it"), (None, "no id here"), (7, "é ß 漢字 \x00 x")]
EXTRA = ", id string, n_words int, label int, bytes binary, key long, component_id long, score double, lang string, __gone string, __spread int, gone int, row string, hits int, items string, `a.b` int"


def docs(spark, rows=TEXTS):
    full = [(i, t, "x", 1, 0, b"", 1, 2, 0.5, "en", "g", 3, 4, "r", 5, "i", 6) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string" + EXTRA)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


TOKENS = public_tokenizers.path("word_bpe_49k.json")
ITEMS = [(1, "one two"), (2, None), (3, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10"), (None, "one"), (1, "one two")]


def items(spark, data=ITEMS):
    return spark.createDataFrame(data, "item_id long, text string")


def labels(spark, data=((1, 0), (4, 1), (5, None), (None, 1), (6, 0), (6, 1))):
    return spark.createDataFrame(list(data), "doc_id long, toxic int")


OPERATORS = {
    "licenses": lambda s, d: licenses.scan(d),
    "packing": lambda s, d: packing.pack(d, TOKENS),
    "decontaminate": lambda s, d: decontaminate.find_hits(d, items(s)),
    "toxicity": lambda s, d: toxicity.score_texts(d, toxicity.train_model(d, labels(s))),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "linedup": lambda s, d: linedup.document_lines(d),
    "substrings": lambda s, d: substrings.repeats(d),
    "langid": lambda s, d: langid.identify(d, langid.train_filter(d)),
}
PER_ROW = set(OPERATORS) - {"packing", "substrings"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    found = OPERATORS[name](spark, docs(spark)).collect()
    if name in PER_ROW:
        assert len(found) == len(TEXTS)
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


@pytest.mark.parametrize(
    "stage",
    [
        lambda s, d: toxicity.keep_clean(d, toxicity.train_model(d, labels(s, [(6, 0)]))),
        lambda s, d: linedup.remove_lines(d),
        lambda s, d: neardup.drop_near_duplicates(d),
        lambda s, d: decontaminate.drop_contaminated(d, items(s)),
        lambda s, d: substrings.remove_repeats(d),
    ],
)
def test_stages_keep_columns_and_odd_rows(spark, stage):
    d = docs(spark)
    found = stage(spark, d)
    assert found.columns == d.columns
    ids = [r["doc_id"] for r in found.collect()]
    assert {1, 2, 3, 6, 7, None} <= set(ids)
    assert stage(spark, docs(spark, [])).collect() == []


def test_toxicity_counts_every_labelled_text(spark):
    many = spark.range(1_000_100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert toxicity.choose_rows(many, many, id_col="doc_id", text_col="text", label_col="toxic").count() == 1_000_100
    # 2,000 left neighbours of one word, each in two texts
    texts = spark.range(4000).selectExpr("0 as label", "concat('w', id div 2, ' word') as text")
    assert toxicity.count_words(texts, 1 << 20).agg(F.max("near")).first()[0] == 2000


def test_licenses(spark):
    found = {r["doc_id"]: r for r in licenses.scan(docs(spark)).collect()}
    assert found[1]["n_words"] == found[2]["n_words"] == found[3]["n_words"] == 0
    assert found[5]["n_words"] == 30_000
    assert [b["start"] for b in found[6]["base"]] == [0]


def test_decontaminate(spark):
    found = {r["doc_id"]: r for r in decontaminate.find_hits(docs(spark), items(spark)).collect()}
    assert found[4]["items"] == [1] and found[1]["items"] == []
    assert found[5]["items"] == [3] and {h["end"] - h["start"] for h in found[5]["hits"]} == {10}
    none = decontaminate.find_hits(docs(spark), items(spark, [])).where("size(items) > 0")
    assert none.count() == 0
    # several blocks give what one gives, for repeated and null ids with different texts too
    odd = docs(spark, [*TEXTS, (5, "one two"), (None, "one two"), (None, "no id here"), (None, None)])
    names = ("doc_id", "n_words", "hits", "items")
    assert {r["doc_id"] for r in decontaminate.maybe_hit(odd.select("doc_id", "text"), items(spark).where("item_id is not null"), 10, 5).collect()} == {4, 5, None}
    assert rows(decontaminate.find_hits(odd, items(spark), block_bytes=20), *names) == rows(decontaminate.find_hits(odd, items(spark)), *names)


def test_near_duplicates(spark):
    found = {r["doc_id"]: r for r in neardup.near_duplicates(docs(spark)).collect()}
    assert found[1]["n_shingles"] == 0 and found[1]["component_id"] == 1 and found[1]["kept"]
    assert found[4]["n_shingles"] == 1 and found[None]["component_id"] is None and found[None]["kept"]


def test_packing_is_whole(spark):
    found = packing.pack(docs(spark), TOKENS).collect()
    by_sequence, by_doc = {}, {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], 0)
        by_doc[r["doc_id"]] += r["length"]
        assert len(r["token_ids"]) == 4 * r["length"]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert by_doc[1] == by_doc[2] == by_doc[3] == 1


def test_langid_without_letters(spark):
    found = {r["doc_id"]: r for r in langid.identify(docs(spark), langid.train_filter(docs(spark))).collect()}
    assert found[1]["lang_pred"] == found[2]["lang_pred"] == "und" and found[4]["lang_pred"] == "en"
    none = langid.identify(docs(spark), langid.train_filter(docs(spark, [])))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_html(spark):
    pages = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, "<p>a</p>" * 5000, None), (4, "<article><p>x &amp; y<p>z</article", "u"), (4, "plain", "u")], "page_id long, html string, url string").withColumn("text", F.lit(1)).withColumn("id", F.lit(2))
    found = html.extract_with_url(pages)
    assert rows(found.where("page_id <> 3"), "page_id", "text", "n_chars") == [(1, "", 0), (2, "", 0), (4, "plain", 5), (4, "x & y\nz", 7)]
    assert html.extract_with_url(pages.limit(0)).count() == 0


def test_balltree(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("score", F.lit(2))
    v = balltree.whole_vectors(table)
    found = balltree.top_k(v, v.where("vec_id % 50 = 0"), 5)
    assert rows(found, "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 81920), (0, 2, 2, 81920), (0, 3, 2, 81920)]
    assert balltree.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_html_of_deep_and_wide_pages():
    import time

    began = time.time()
    assert html.main_text("<font>" * 100_000 + "x<br>" * 100_000) == " ".join("x" * 100_000)
    assert html.main_text("<p><table>" + "<span>" * 50_000 + "<hr>z" * 50_000).count("z") == 50_000
    html.main_text("<span>" * 50_000 + "<p>y" * 50_000)
    assert time.time() - began < 20


def test_html_keeps_every_content_region():
    sections = [" ".join(f"w{i}" for i in range(n)) for n in (60, 20, 12)]
    page = "".join(f"<section>{s}</section>" for s in sections)
    assert html.main_text(page) == "\n".join(sections[:2]) or html.main_text(page) == "\n".join(sections)
    assert html.main_text(f'<article><p class="banner-year">{sections[1]}</p><p>{sections[0]}</p><div class="top-banner">ad</div></article>') == f"{sections[1]}\n{sections[0]}"


def test_many_passages_of_one_document(spark):
    """20,000 repeated lines between lines of their own: as many passages, each removed."""
    own = "\n".join(f"own line {i}\nshared line {i % 7} of all" for i in range(20_000))
    d = spark.createDataFrame([(1, "\n".join(f"shared line {i} of all" for i in range(7))), (2, own)], "doc_id long, text string")
    found = substrings.repeats(d)
    assert found.where("doc_id = 2").count() == 20_000 and {r["method"] for r in found.select("method").distinct().collect()} == {"lines"}
    left = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(d).collect()}
    assert "shared" not in left[2] and left[2].count("own line") == 20_000 and left[1].count("shared") == 7
