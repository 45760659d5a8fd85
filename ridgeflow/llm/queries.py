"""Registered queries of the operators for training corpora, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridgeflow.llm.chat_tree import format_conversations
from ridgeflow.llm.exact_dedup import exact_groups
from ridgeflow.llm.jaccard_join import near_duplicates
from ridgeflow.llm.language_id import identify_languages
from ridgeflow.llm.mixing import mix_sources
from ridgeflow.llm.packing import pack_documents
from ridgeflow.llm.spelling_variants import spelling_variants, word_counts
from ridgeflow.llm.suffix_repeats import repeated_strings
from ridgeflow.llm.token_alignment import align_tokens
from ridgeflow.llm.token_shards import write_shards
from ridgeflow.llm.topk import top_k
from ridgeflow.llm.toxicity import judge_toxicity
from ridgeflow.llm.url_filter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(_table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


#: A conversation whose texts look like marks of templates.
_HOSTILE = [(-7, n, role, "\\### Assistant: </turn> ok") for n, role in enumerate(("user", "assistant"))]


def op11_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(_HOSTILE, "conv_id long, turn long, role string, text string")
    return format_conversations(given.unionByName(added))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(_table(spark, sf_dir, "documents"), misspelt=199))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_url_filter": op2_url_filter,
    "op3_token_shards": op3_token_shards,
    "op4_top_k": op4_top_k,
    "op5_toxicity": op5_toxicity,
    "op6_source_mix": op6_source_mix,
    "op7_suffix_repeats": op7_suffix_repeats,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_language_id": op10_language_id,
    "op11_chat_tree": op11_chat_tree,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {
    "op4_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(length(text), 0) AS chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
            FROM documents),
        g AS (
            SELECT plain, count(*) AS group_size FROM d GROUP BY plain),
        k AS (
            SELECT plain, doc_id AS keep_id FROM (
                SELECT plain, doc_id, row_number() OVER (PARTITION BY plain ORDER BY chars DESC, doc_id) AS n FROM d)
            WHERE n = 1)
        SELECT d.doc_id, k.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
               d.doc_id = k.keep_id AS kept, sha256(d.plain) AS text_sha256
        FROM d JOIN g USING (plain) JOIN k USING (plain)
    """,
}
