"""From raw documents to encoded training text: the stages, and a run over all of them.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``. Rejected documents are gone for later stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldlog.llm import byte_bpe, decontaminate, kit, line_dedup, ngram_join, quality_rules

STAGES = [
    ("quality rules", quality_rules.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("byte-level BPE", byte_bpe.stage),
]

#: Alignment (longest increasing subsequences) and BPE merges have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = kit.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for k, (_, stage) in enumerate(STAGES):
        name = f"stage{k}"
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
