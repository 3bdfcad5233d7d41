"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlake.llm import balltree, bytebpe, decontaminate, html, langid, licenses, linedup, neardup, negatives, packing, periods, substrings, toxicity
from meterlake.llm.tasks import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda x: x["start"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda x: x["label"]), F.transform("detections", lambda x: x["label"]))))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce(F.array_max(F.concat(F.transform("detections", lambda x: x["weight"]), F.transform("base", lambda x: F.lit(0.5)))), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    hit = decontaminate.n_hit("hits")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train_model(docs, labels.where(crc_mod("doc_id", 4) != 2))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_with_url(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.document_lines(table(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = balltree.whole_vectors(table(spark, sf_dir, "embeddings"))
    return balltree.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train_filter(docs.where(crc_mod("doc_id", 5) != 0))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bytebpe.decode(bytebpe.encode(table(spark, sf_dir, "documents"), ranks_path()), ranks_path())
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return tokens.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text; in texts whose hash h of the id is divisible by 10, the words from a on repeat the first p of them."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    planted = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    planted = planted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    made = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return planted.select("doc_id", F.when(F.col("n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(with_planted_runs(table(spark, sf_dir, "documents")), powers=4, least=6)
    found = found.withColumn("best", F.array_min(F.transform("runs", lambda x: F.struct((-x["length"]).alias("less"), x["start"].alias("start"), x["period"].alias("period")))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.labelled_vectors(table(spark, sf_dir, "embeddings"), label)
    mined = negatives.mine(vectors, vectors.where("id % 100 = 0"))
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


def queries() -> dict:
    every = (op1_license_scan, op2_packing, op3_decontamination, op4_toxicity, op5_near_dedup, op6_html_extraction, op7_line_dedup, op8_topk_search, op9_substring_dedup, op10_language_id, op11_byte_bpe, op12_periodic_runs, op13_hard_negatives)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

SQL = {
    "op3_decontamination": f"""
        with d as (select doc_id, {_WORDS} as w from documents),
        i as (select item_id, w, least(len(w), 10) as k from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
        iw as (select distinct item_id, k, array_to_string(w[p + 1 : p + k], ' ') as g from (select *, unnest(range(len(w) - k + 1)) as p from i)),
        dw as (select doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') as g
               from (select doc_id, w, k, unnest(range(len(w) - k + 1)) as p from d, (select distinct k from i) where len(w) >= k)),
        m as (select doc_id, item_id, p, k from dw join iw using (k, g)),
        h as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from m) group by 1),
        t as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as s from (select distinct doc_id, cast(item_id as varchar) as s from m) group by 1)
        select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join h using (doc_id) left join t using (doc_id)""",
    "op8_topk_search": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
                   where vec_id is not null and embedding is not null and len(embedding) > 0
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""",
    "op13_hard_negatives": """
        with v as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                          list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
                   where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.id as anchor_id, c.id, q.label = c.label as same,
                     cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
              from v q join v c on q.id <> c.id and len(q.v) = len(c.v) where q.id % 100 = 0),
        p as (select anchor_id, id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, id) as positive_rank
              from s where same qualify positive_rank <= 5),
        n as (select p.*, s.id as negative_id, s.score as negative_score,
                     row_number() over (partition by p.anchor_id, positive_rank order by s.score desc, s.id) as rank
              from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * s.score and s.score <= positive_score)
        select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score, cast(positive_rank as integer) as positive_rank
        from n where rank <= 5""",
}
