"""The training-data pipeline: documents through five stages, each a Spark job of its own.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet
to the shared folder and rereads it as the next stage's docs. All stages but the last return
the columns of documents, for the rows that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeweave.llm import decontam, exact_dedup, jaccard, packing, quality
from tapeweave.llm.common import table
from tapeweave.session import written

STAGES = [
    ("quality", quality.accepted),
    ("exact_dedup", exact_dedup.keep_one_each),
    ("ngram_jaccard", jaccard.keep_one_each),
    ("decontamination", decontam.clean),
    ("packing", packing.packed),
]

# SQL can state neither the fitted scorer nor the sequences that a linear program gives.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
