"""From raw documents to token ids, in stages that each write Parquet for the next.

Quality rules drop documents and shared lines, near-duplicate removal keeps one document of
each group, secrets are replaced, sources are mixed to target weights (documents may
repeat), and what remains is encoded.

A document without text, or with fewer words than the quality rules ask for, goes in the first stage; documents
without doc_id, lang or source are kept like others, of repeated rows one stays. Texts are worked on whole, however
long. Columns that documents do not have go with the first stage, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlens.llm.bpe import bpe_stage
from eventlens.llm.common import stored, table
from eventlens.llm.jaccard import near_duplicates_stage
from eventlens.llm.mixing import mixing_stage
from eventlens.llm.quality import quality_stage
from eventlens.llm.secrets import secrets_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secret_scans", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Secret scans, the mix of what they leave and token ids have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
