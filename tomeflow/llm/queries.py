"""The registered queries of this subpackage: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .flac import digested

    return digested(table(spark, sf_dir, "documents"))


def op4_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "expected")


def op5_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import sharded

    return sharded(table(spark, sf_dir, "documents"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import joined

    return joined(table(spark, sf_dir, "documents"), n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op2_toxicity_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fitted, scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))


def op6_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op7_language_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fitted, identified

    docs = table(spark, sf_dir, "documents")
    return identified(docs, fitted(docs))


def op8_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import fingerprinted

    return fingerprinted(table(spark, sf_dir, "documents"))


def op9_site_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op10_quality_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fitted, scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))


def op11_aho_corasick_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import grouped

    return grouped(table(spark, sf_dir, "documents"))


def op12_suffix_bucket_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


def op13_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_toxicity_factorization_machine,
        op3_flac_media,
        op4_pareto_mixing,
        op5_virtual_slot_sharding,
        op6_lexical_packing,
        op7_language_naive_bayes,
        op8_syncmer_fingerprints,
        op9_site_template_extraction,
        op10_quality_line_crf,
        op11_aho_corasick_variants,
        op12_suffix_bucket_dedup,
        op13_lobpcg_whitening,
    )
}
#: SQL compares all pairs of documents that share a shingle, so it suits small tables; tests hold the operator against brute force, too.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)]) END AS shingles FROM w),
    g AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, max(a.n) + max(b.n) AS n FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs WHERE 100 * common >= 90 * (n - common)), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached AS (SELECT a AS node, a AS least FROM edges UNION SELECT e.b, r.least FROM reached r JOIN edges e ON e.a = r.node)
    SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, coalesce((SELECT min(least) FROM reached WHERE node = doc_id), doc_id) AS component_id FROM s""",
}
