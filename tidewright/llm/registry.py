"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import bpe, centroids, html_blocks, license_scan, line_spread, ngram_rules, pareto_mix, piecewise, ppm_language, quality_compression, setsketch, token_cache, wavelet_search
from tidewright.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by two trained dictionaries; fitted on labelled rows that aren't
    held out. Null and empty texts: the base rate. Repeated rows each."""
    docs = table(spark, sf_dir, "documents")
    model = quality_compression.train_compression(docs, table(spark, sf_dir, "labels"))
    return quality_compression.score_compression(docs, model)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses of lines that ten sites share. Null text: no lines; ties: the
    smallest doc_id keeps a line."""
    return line_spread.line_report(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by frozen context trees. No letters: ``und``, score 0. Ties: the
    first language by code point."""
    docs = table(spark, sf_dir, "documents")
    return ppm_language.identify(docs, ppm_language.train_ppm(docs))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. No words: none; repeated ids are sampled
    apart; a null source is one source."""
    return pareto_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document. Null text: no words, base_failed."""
    docs = table(spark, sf_dir, "documents")
    return ngram_rules.judge(docs, ngram_rules.train_ngram(docs, table(spark, sf_dir, "labels")))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and decoded text. Null text: that of an empty one."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under two-word shingles and 0.8. No words: alone, kept; null
    doc_id: null component, kept."""
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null or textless html: an empty text."""
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text. Null text: an empty one; equal ids by
    text."""
    out = piecewise.fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, through the lasting cache of this folder's tables. Null
    text: an empty one."""
    return token_cache.token_counts(table(spark, sf_dir, "documents"), cache=token_cache.cache_of(spark, sf_dir))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every whole finite vector of 64 components. Others: no row; ties: the smaller
    cluster; rows that repeat an id are vectors each."""
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document. Null text: an empty one, no labels, score 0."""
    return license_scan.scan(table(spark, sf_dir, "documents"), spans=False)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item. Null texts: never found, and find nothing;
    ties: the smaller doc_id."""
    return wavelet_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages over documents; odd rows as each stage says."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_quality_classifier, op2_line_dedup, op3_language_id, op4_source_mix, op5_quality_rules, op6_bpe_codec, op7_near_duplicates, op8_html_text, op9_fingerprints, op10_token_counts, op11_centroids, op12_license_scan, op13_ranked_search, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_spread.ORACLE, "op4_source_mix": pareto_mix.ORACLE, "op11_centroids": centroids.ORACLE, "op13_ranked_search": wavelet_search.ORACLE}
