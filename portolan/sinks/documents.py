"""Results as JSON: rows of one table, or one nested document per reporter."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.functions.numeric import no_nan


def plain(df: DataFrame) -> DataFrame:
    """NaN cells as NULL; JSON has no NaN."""
    return df.select(
        *[
            no_nan(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; missing values are written as null."""
    plain(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def result_document(sections: Mapping[str, DataFrame], by: str = "reporter") -> DataFrame:
    """One JSON document per reporter: ``(reporter, document)``.

    A section is a table with the reporter column; its rows become a sorted list
    of objects with named fields.  Sections are report results (yearly series,
    statistics, ranked lists), so a reporter's document stays small.  Tables
    without a reporter do not belong here; write them with ``write_json``.
    """
    lists = []
    for name, df in sections.items():
        rest = [c for c in df.columns if c != by]
        rows = F.array_sort(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in rest])))
        lists.append(plain(df).groupBy(by).agg(rows.alias(name)))
    joined = reduce(lambda a, b: a.join(b, by, "full"), lists)
    body = F.to_json(F.struct(by, *[F.coalesce(F.col(f"`{n}`"), F.array()).alias(n) for n in sections]),
                     {"ignoreNullFields": "false"})
    return joined.select(by, body.alias("document"))
