"""A corpus pipeline of five operators, each stage over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. A stage's result is written as Parquet and read again as the docs of
the next one.

1. quality: documents that the rules reject go; failing lines of the others are removed.
2. line_dedup: later copies of repeated runs of lines are deleted; a document that loses lines
   and is left with fewer words than the first stage demands goes.
3. near_dedup: of each group of near-duplicates the document with the least doc_id stays; two
   documents are near from 80 % of common shingles on.
4. secrets: secrets are replaced by their kinds.
5. packing: the documents' tokens are packed into sequences.

Defined results: a document with a null or empty text, or fewer than 50 words, goes in the first
stage. A very long text is treated whole, by one task of each stage. Of equal documents, and of
rows that repeat a doc_id, one stays: in line_dedup, ties in doc_id go by a hash of the text; in
near_dedup, of rows with one doc_id the one whose text has the least hash stays. Rows with a null
doc_id are cleaned and packed like others but are never near copies. An empty table gives an empty
result. Other columns of documents, whatever their names, are passed on by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callgrid.llm import linededup, minhash, packing, quality, secrets
from callgrid.llm.common import Scratch, load, small_batches

#: The packing needs a tokenizer, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.clean_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return linededup.clean_documents(docs, least_words=quality.MIN_WORDS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash.keep_one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", clean), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("secrets", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.keep_only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
