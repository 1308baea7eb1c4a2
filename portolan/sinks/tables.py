"""Several named result tables written side by side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """Writes each table to ``folder/name`` and returns the paths.

    CSV has no nested values; such columns are written as JSON text.
    """
    paths = []
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        writer = (_flat(df) if fmt == "csv" else df).write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(path)
        paths.append(path)
    return paths


def _flat(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
