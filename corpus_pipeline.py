"""The corpus pipeline: language ID, exact and near-deduplication, benchmark decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows to the shared folder and reads them back: every stage works on all rows that the one before
it kept, and lineage ends between stages.

Cases: null and empty texts have no language, so the first stage drops them; repeated rows are exact copies, of which
one stays; very long texts are read whole; ties are settled as each operator states; an empty table gives no rows; other
columns of documents pass through, also those that are named as an operator's output (one named as an output of the
last stage is replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scribegauge.llm.common import rows_kept, table, written
from scribegauge.llm.decontaminate import decontaminate
from scribegauge.llm.exact_dedup import exact_dedup
from scribegauge.llm.language_id import keep_identified
from scribegauge.llm.mixing import mix_sources
from scribegauge.llm.near_dedup import near_dedup


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go."""
    return keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return rows_kept(docs, lambda rows: exact_dedup(rows).where("kept"), "doc_id", "text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays."""
    return rows_kept(docs, lambda rows: near_dedup(rows).where("kept"), "doc_id", "text")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes, and how often (copies)."""
    return mix_sources(docs).where("copies > 0")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("source_mixing", mixing_stage),
]

#: Language models, sketches and the seeded mix are beyond SQL; a test compares the run with plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
