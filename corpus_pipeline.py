"""From documents to token ids in five stages; each calls one operator of ``terralog.llm``.

A stage takes the documents that the one before it kept, whole, and all but the last
return rows with the columns of ``documents``.  What a stage returns is stored as Parquet
in the cluster's shared folder and read again by the next, so a lost executor costs the
tasks of one stage at most.

Null, empty and very long texts, repeated rows, null ids, empty tables and further columns
are handled as each operator states.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from terralog.llm import decontamination, ngram_join, piece_tokens, quality_rules, secret_scans
from terralog.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the others go."""
    return quality_rules.keep(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return ngram_join.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows do not contaminate."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by its kind in brackets."""
    return secret_scans.redacted(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of every document."""
    return piece_tokens.tokens(docs, piece_tokens.default_path())


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", deduplicate),
    ("decontamination", decontaminate),
    ("secret_scans", redact),
    ("piece_tokens", tokenize),
]

#: The stages weigh votes by iteration and encode by a vocabulary, which SQL does not
#: express; tests hold every stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order, from the whole ``documents`` table."""
    first = table(spark, sf_dir, "documents")
    return reduce(lambda docs, stage: stored(stage[1](spark, docs, sf_dir), stage[0]), STAGES, first)
