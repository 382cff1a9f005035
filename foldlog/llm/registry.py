"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldlog.llm import byte_bpe, decontaminate, filter_audit, importance_resampling, line_dedup, ngram_join, ngram_trie, pii, pu_quality, quality_rules, run_length_index, sharding, super_kmer


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": ngram_join.query,
        "op2_quality_rules": quality_rules.query,
        "op3_decontaminate": decontaminate.query,
        "op4_byte_bpe": byte_bpe.query,
        "op5_sharding": sharding.query,
        "op6_pii": pii.query,
        "op7_line_dedup": line_dedup.query,
        "op8_run_length_index": run_length_index.query,
        "op9_pu_quality": pu_quality.query,
        "op10_ngram_trie": ngram_trie.query,
        "op11_super_kmer": super_kmer.query,
        "op12_filter_audit": filter_audit.query,
        "op13_importance_resampling": importance_resampling.query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.ORACLE, "op11_super_kmer": super_kmer.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
