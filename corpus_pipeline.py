"""The corpus pipeline: quality, near duplicates, contamination, personal data and the source mix.

Each stage works on all that the one before kept and is written to the shared folder before the next
reads it, so a lost executor costs at most one stage's work, and a named run that lost its driver resumes
after its last finished stage. Every stage but the last returns the columns of ``documents``; the last adds
each document's size, its source's size and target and the words taken, and its text is what the mix takes of
it. A null id is never dropped as a duplicate; rows that repeat one id stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import discard, documents, run_stage, without
from quillgraph.llm.decontaminate import drop_contaminated
from quillgraph.llm.mixing import mix_sources
from quillgraph.llm.ngram_join import jaccard_components
from quillgraph.llm.pii import redact_pii
from quillgraph.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays."""
    return without(docs, "doc_id", jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified overlap with a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers in the texts are replaced by their kind."""
    return redact_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and how many words that is; none of some documents."""
    return mix_sources(docs, texts=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: No stage order of this kind has a SQL form (a fitted classifier, Python transducers): see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, resume: str | None = None) -> DataFrame:
    """All stages over ``documents``, each written and read again; ``resume`` names a run that may be taken up again."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs, path = run_stage(spark, f"stage-{name}", lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), resume)
        if last and resume is None:
            discard(spark, last)
        last = path
    return docs
