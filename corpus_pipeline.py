"""The corpus pipeline: five stages from raw documents to token ids.

Each stage works on all that its predecessor kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portolan.llm import bpe, lines, mixing, probminhash, quality
from portolan.llm.common import stored, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Names that Spark gives to the files of a table: the partition and the file in it.
PART = r"part-(\d+)-.*[.-]c(\d+)\."


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are furniture of their host."""
    return quality.apply_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the first line of each class of near-equal lines only."""
    return lines.dedup_lines(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return probminhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted so that their sources follow the target weights."""
    return mixing.mixed_order_exact(docs)


def _written(docs: DataFrame) -> DataFrame:
    """``docs`` as a table in files that Spark wrote, whose names and rows hold the order."""
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    files = docs.inputFiles() if plain else []
    return docs if files and all(re.search(PART, f.rsplit("/", 1)[-1]) for f in files) else stored(docs)


def _placed(docs: DataFrame) -> DataFrame:
    """(position, doc_id, text): the number of each row, from 0, in the order in which its table was written.

    Unlike the order of a scan it does not change. A row's number is its place in
    its file and the rows of all files before; only the list of files is sorted.
    """
    rows = docs.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "text")
    part, file = (F.regexp_extract("file", PART, i).cast("long") for i in (1, 2))
    before = Window.orderBy(part, file, "file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    # written, so that the planner knows how small it is
    starts = stored(files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    return rows.join(starts, "file").select((F.col("start") + F.col("row")).alias("position"), "doc_id", "text")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and of the decoded bytes of each document, and its position in the order of ``docs``."""
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    placed = _placed(_written(docs))
    # the encoder returns rows in no order; under their positions they find their ids and their order again
    texts = placed.select(F.col("position").alias("doc_id"), "text")
    found = bpe.digest(bpe.decode(bpe.encode(texts, ranks, public_tokenizers.PATTERN), ranks)).withColumnRenamed("doc_id", "position")
    out = placed.select("position", "doc_id").join(found, "position").orderBy("position")
    return out.select("doc_id", *[c for c in found.columns if c != "position"], "position")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: Edit distances, signatures and merges are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again by the next.

    The rows come in the mixed order and carry their position in it, so that the
    mix outlasts any join or new partitioning.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
