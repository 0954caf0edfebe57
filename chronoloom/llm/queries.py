"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm._shared import cut, dropped, read, scratch_path


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm import pii

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return pii.pseudonymised(docs, key=pii.key_of(spark))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm import chat

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], turns.schema)
    return chat.read_back(chat.format_conversations(chat.as_log(turns.unionByName(extra))))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), j AS (
  SELECT conv_id, count(*) AS n_turns,
    coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text), '') AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  cast(formatted_chars AS BIGINT) AS formatted_chars
FROM j
"""


def op3_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm import html

    return html.extracted(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm import packing

    return packing.pack(read(spark, sf_dir, "documents"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm import warc

    manifest = warc.archived(read(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm import toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fitted(docs, read(spark, sf_dir, "labels"))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm import neardup

    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm import decontam

    found = decontam.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontam.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bk AS (
  SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS said FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS said
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), hits AS (
  SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.said = bw.said
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm import ann

    return ann.neighbours(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


def op10_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm import sharding

    path = scratch_path(spark, "shards")
    sharding.write(sharding.shard(read(spark, sf_dir, "documents"), 24, seed=20240101), path)
    found = spark.read.parquet(path)  # sizes and sums are those of the shards as they were written
    said = F.coalesce("text", F.lit(""))
    out = found.select(
        "doc_id",
        (F.octet_length(said) + 8).cast("long").alias("size"),
        F.crc32(said.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
    out = cut(out)
    dropped(spark, path)
    return out


QUERIES = {f.__name__: f for f in (op1_pii_surrogates, op2_chat_formatting, op3_html_consensus, op4_best_fit_packing, op5_warc_round_trip, op6_toxicity, op7_chosen_path, op8_decontamination, op9_kmeans_tree, op10_two_pass_shuffle)}
ORACLE_SQL: dict[str, str] = {"op2_chat_formatting": OP2_SQL, "op5_warc_round_trip": OP5_SQL, "op8_decontamination": OP8_SQL}
