"""The queries of this subpackage, by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vanefold.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanefold.llm.token_counts import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_path("byte_bpe_50k.json"), limit=512)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanefold.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanefold.llm.suffix_dedup import dedup_report

    return dedup_report(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanefold.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanefold.llm.media import media_features, media_files

    return media_features(media_files(table(spark, sf_dir, "documents")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanefold.llm.pieces import report

    return report(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanefold.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanefold.llm.secret_scan import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanefold.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vanefold.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_media_columns": op5_media_columns,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_html_extraction": op7_html_extraction,
        "op8_secret_scans": op8_secret_scans,
        "op9_packing": op9_packing,
        "op10_document_fingerprints": op10_document_fingerprints,
    }


#: Links are counted pair by pair and followed by recursion: for small tables only.
OP2_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words
), classes AS (
    SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS h FROM sets
), named AS (
    SELECT doc_id, n, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY n, h) END AS class_id FROM classes
), grams AS (
    SELECT doc_id, unnest(s) AS g FROM sets WHERE doc_id IN (SELECT class_id FROM named WHERE n > 0)
), met AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM met JOIN named x ON x.doc_id = a JOIN named y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), edges AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
    SELECT DISTINCT class_id AS a, class_id AS b FROM named UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), least AS (
    SELECT a, min(b) AS component FROM reach GROUP BY a
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component AS component_id, class_id FROM named JOIN least ON least.a = class_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL}
