"""Corpus preparation: from ``documents`` to a token file, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``.  All but the last return
the columns that they were given.  Every stage works on all rows its predecessor
kept, each on whole texts:

1. ``quality_rules``: documents that fail the base rules or lie outside their
   language's perplexity band go.
2. ``jaccard_join``: of each group of near copies (five-word shingles, Jaccard
   0.75 or more) one document stays, the one with the least id.
3. ``decontaminate``: documents with a passage of ``benchmark`` go.
4. ``source_mixing``: all documents, in the order of the sources' Pfair schedule.
5. ``token_blocks``: the documents are encoded and written in that order (the
   schedule depends on the documents' keys alone, so it is the one of stage 4), and
   read back: doc_id, start, n_tokens, ids_crc32.

A stage removes the scratch tables of the stage before it, whose output is written
then; if its ``docs`` still reads one of them (a stage's result that was not
written), they stay.

Nulls, empty and very long texts, repeated rows, empty tables and further
columns follow the operators' definitions: a row without words goes in stage 1;
of rows that share an id and have words, one stays; further columns are kept up
to stage 4, whatever their names (the last stage's mix columns excepted).
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from prefixery.llm import decontaminate, jaccard_join, quality_rules, source_mixing, token_blocks
from prefixery.llm.common import remove_scratch, scratch_scope, stored, table

_left: list[str] = []      # scratch tables of the last stage


def _stage(work):
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_scratch(_left, docs)
        with scratch_scope() as own:
            out = work(spark, docs, sf_dir)
        _left.extend(own)
        return out

    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


@_stage
def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.representatives(docs)


@_stage
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.mixed(docs)


@_stage
def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_blocks.tokenized(source_mixing.schedule(docs.select("doc_id", "text", "source")), order=("mix_position",))


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", copies_stage),
    ("decontaminate", benchmark_stage),
    ("source_mixing", mixing_stage),
    ("token_blocks", tokens_stage),
]

# Perplexity and the token file have no SQL; the tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    remove_scratch(_left, docs)
    return docs
