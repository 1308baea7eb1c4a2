"""Whole results: section tables in folders, a manifest, and a small document per reporter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.sinks.documents import plain, result_document

SECTIONS, MANIFEST, DOCUMENTS = "sections", "manifest", "documents"


def _place(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{SECTIONS}/{name}"


def read_section(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A section as it was written; ``schema`` is that of its table."""
    return spark.read.schema(schema).json(_place(folder, name))


def write_sections(sections: Mapping[str, DataFrame], folder: str, by: str = "reporter", inline: Sequence[str] = ()) -> DataFrame:
    """Writes every section as JSON rows, a folder per value of ``by``, and returns the manifest.

    The manifest (``by``, section, path, rows) counts the rows read back from the
    files; a section without ``by`` has one line with NULL there, one without rows none. Sections named by
    ``inline``, a few rows per value, also stand in the documents, next to the
    manifest's lines: a document is as long as there are sections, however long
    these are.
    """
    lines = []
    for name, df in sections.items():
        out = plain(df)
        writer = out.write.mode("overwrite").option("ignoreNullFields", False)
        (writer.partitionBy(by) if by in df.columns else writer).json(_place(folder, name))
        back = read_section(df.sparkSession, folder, name, out.schema)
        key = F.col(by) if by in df.columns else F.lit(None)
        lines.append(
            back.groupBy(key.cast("long").alias(by)).agg(F.count("*").alias("rows"))
            .select(by, F.lit(name).alias("section"), F.lit(_place(folder, name)).alias("path"), "rows")
        )
    spark = lines[0].sparkSession
    place = f"{folder.rstrip('/')}/{MANIFEST}"
    listed = reduce(DataFrame.unionByName, lines)
    listed.write.mode("overwrite").parquet(place)
    manifest = spark.read.schema(listed.schema).parquet(place)
    shown = {name: read_section(spark, folder, name, plain(sections[name]).schema).withColumn(by, F.col(by).cast("long")) for name in inline}
    result_document({**shown, SECTIONS: manifest.filter(F.col(by).isNotNull())}, by).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{DOCUMENTS}")
    return manifest
