"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.llm.alignment import link_quality
from unitweave.llm.chat import format_chats, read_chats
from unitweave.llm.common import documents
from unitweave.llm.contamination import LOWER, PATTERN, UPPER, find_contamination
from unitweave.llm.mixing import mix_sources
from unitweave.llm.near_dup import near_duplicate_classes
from unitweave.llm.packing import pack_documents
from unitweave.llm.pii import find_personal_data
from unitweave.llm.quality import quality_verdicts
from unitweave.llm.secrets import scan_secrets
from unitweave.llm.suffix_dedup import remove_repeats
from unitweave.llm.topk import binary_codes, top_k
from unitweave.llm.toxicity import learn_lexicon, score_toxicity
from unitweave.llm.whitening import fit_whitening, whiten

#: Score from which a document is predicted toxic.
TOXIC_FROM = 0.7


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, learn_lexicon(docs, training_labels(spark, sf_dir)))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    read = read_chats(format_chats(turns.union(probe)))
    loss = F.array_join("loss_texts", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = binary_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(codes, codes.where("vec_id % 100 = 0"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(documents(spark, sf_dir))


def op11_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(vectors, fit_whitening(vectors))


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quality(documents(spark, sf_dir))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity,
        op2_mix_sources,
        op3_suffix_dedup,
        op4_quality_rules,
        op5_secret_scan,
        op6_chat_format,
        op7_top_k,
        op8_personal_data,
        op9_best_fit_packing,
        op10_order_minhash,
        op11_whiten_embeddings,
        op12_align_tokenizers,
        op13_decontaminate,
    )
}

_ESCAPED = "replace(replace(replace(replace(replace(replace(replace(replace({}, '\\', '\\b'), '<|', '\\m'), '<s>', '\\s'), '</s>', '\\e'), '[INST]', '\\i'), '[/INST]', '\\j'), '<<SYS>>', '\\y'), '<</SYS>>', '\\z')"

ORACLE_SQL: dict[str, str] = {
    "op6_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format('text')}) + CASE WHEN before IS NOT DISTINCT FROM role THEN 8 ELSE 23 + length({_ESCAPED.format('role')}) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id""",
    "op7_top_k": """
WITH codes AS (SELECT vec_id, list_transform(generate_series(1, 64), lambda i: coalesce(embedding[i] > 0, false)) AS bits FROM embeddings WHERE vec_id IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, 64), lambda i: CASE WHEN q.bits[i] <> c.bits[i] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM codes q, codes c WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10""",
    "op13_decontaminate": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PATTERN}') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}') AS ws FROM benchmark),
windows AS (
  SELECT item_id, least(len(ws), 10) AS n, unnest(list_transform(generate_series(1, greatest(len(ws) - 9, 1)), lambda i: array_to_string(ws[i:i + 9], ' '))) AS said
  FROM items WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM docs, sizes),
matches AS (SELECT s.r, s.i, s.n, w.item_id FROM (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS said FROM spots) s JOIN windows w USING (n, said)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM matches) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM matches WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN found USING (r)""",
}
