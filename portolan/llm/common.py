"""Shared helpers of the corpus operators: tables, row keys and runs of sorted Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.plans.session import ensure_checkpoints, shared_folder

LAST = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables below a folder that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder: a lost executor costs a read, not a recomputation."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Written as a compressed table in the shared folder and read again; takes less room than a checkpoint."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Join key of a document: its id, or a hash of its text where the id is NULL.

    Rows may share a key. The operators only join facts by it that hold for any
    row with the same content, so that a shared key never changes a result.
    """
    return F.coalesce(F.col(id_col), F.xxhash64(F.col(text_col)))


def order_id(id_col: str = "doc_id") -> Column:
    """Order of a document: its id; a NULL id comes after all others."""
    return F.coalesce(F.col(id_col), F.lit(LAST))


def groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Cuts sorted batches into tables of about ``rows`` rows that hold every group of ``key`` whole."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key)
        last, low, high = keys[-1].as_py(), 0, whole.num_rows - 1
        while low < high:  # first row of the last group, which may go on in the next batch
            middle = (low + high) // 2
            low, high = (middle + 1, high) if keys[middle].as_py() != last else (low, middle)
        if low:
            yield whole.slice(0, low)
        held = whole.slice(low).combine_chunks().to_batches() if low else held
        count = whole.num_rows - low
    if held:
        yield pa.Table.from_batches(held)
