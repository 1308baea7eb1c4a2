"""Reading, checking, cleaning and enriching the three input tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan import schema as S
from portolan.functions import codes, numeric
from portolan.operators import quality
from portolan.operators.directional import touching
from portolan.plans.session import written


class TradeData(NamedTuple):
    """The fact table and its two dimensions."""

    flows: DataFrame
    countries: DataFrame
    products: DataFrame


class SourceError(ValueError):
    """A source is missing or unusable."""


# Text markers of a missing cell.
MISSING = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
#: Column of the cells of a row that could not be read.
REJECTS = "_rejects"
_RECORD = "_record"


def _opened(spark: SparkSession, path: str, schema: T.StructType, fmt: str | None) -> tuple[DataFrame, bool]:
    """The table, and whether its cells are still text."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    try:
        if fmt != "csv":
            return spark.read.format(fmt).load(path), False
        text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields], T.StructField(_RECORD, T.StringType())])
        return (
            spark.read.schema(text)
            .option("header", True)
            .option("encoding", "UTF-8")
            .option("enforceSchema", False)
            .option("columnNameOfCorruptRecord", _RECORD)
            .csv(path),
            True,
        )
    except AnalysisException as e:
        raise SourceError(f"cannot read {path}: {e.getMessage()}") from e


def _number(text: Column, kind: T.DataType) -> Column:
    """The number in a text, NULL where there is none; whole numbers may be written with a zero fraction."""
    name = kind.simpleString()
    if not isinstance(kind, T.IntegralType):
        return numeric.no_nan(text.try_cast(name))
    real = text.try_cast("double")
    return F.coalesce(text.try_cast(name), F.when(real == F.floor(real), real.try_cast(name)))


def with_rejects(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text cells as typed columns, NULL where missing or unreadable, and the unreadable ones in ``_rejects``.

    ``_rejects`` is an array of (column, cell). A record with too many or too few
    cells counts as one unreadable cell of no column. All of it comes from the same
    scan as the values; readers that do not use the array do not pay for it.
    """
    typed, bad = [], []
    for f in schema.fields:
        text = F.col(f.name)
        known = F.when(~F.trim(text).isin(*MISSING) & (F.trim(text) != ""), text)
        if isinstance(f.dataType, T.StringType):
            typed.append(F.when(~text.isin(*MISSING), text).alias(f.name))
            continue
        value = _number(known, f.dataType)
        typed.append(value.alias(f.name))
        bad.append(F.when(known.isNotNull() & value.isNull(), F.struct(F.lit(f.name).alias("column"), text.alias("cell"))))
    bad.append(F.when(F.col(_RECORD).isNotNull(), F.struct(F.lit("").alias("column"), F.col(_RECORD).alias("cell"))))
    return df.select(*typed, F.array_compact(F.array(*bad)).alias(REJECTS))


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str | None) -> DataFrame:
    df, text = _opened(spark, path, schema, fmt)
    return with_rejects(df, schema).drop(REJECTS) if text else df


def read_with_rejects(spark: SparkSession, path: str, schema: T.StructType = S.FLOW, fmt: str | None = None) -> DataFrame:
    """A table with ``_rejects`` beside its columns; tables with types of their own have none."""
    df, text = _opened(spark, path, schema, fmt)
    none = F.array().cast("array<struct<column: string, cell: string>>")
    return with_rejects(df, schema) if text else df.withColumn(REJECTS, none)


def _rejects_of(column: str) -> Column:
    return F.filter(REJECTS, lambda r: r["column"] == column)


def reject_report(rows: DataFrame, columns: Sequence[str] = S.FLOW_COLUMNS) -> DataFrame:
    """(column_name, records, known, unreadable, example) of a table with rejects, in one pass; '' names broken records."""
    cells = []
    for c in columns:
        mine = _rejects_of(c)
        cells += [F.lit(c), F.col(c).isNotNull().cast("long"), F.size(mine).cast("long"), F.get(mine, 0)["cell"]]
    broken = _rejects_of("")
    cells += [F.lit(""), F.lit(0).cast("long"), F.size(broken).cast("long"), F.get(broken, 0)["cell"]]
    long = rows.select(F.stack(F.lit(len(columns) + 1), *cells).alias("column_name", "known", "unreadable", "example"))
    return long.groupBy("column_name").agg(
        F.count("*").alias("records"), F.sum("known").alias("known"), F.sum("unreadable").alias("unreadable"), F.min("example").alias("example")
    )


def _judge(report: list, max_rejects: int) -> None:
    """Raises on a column without a single number among its cells, and on more unreadable cells than allowed."""
    for r in report:
        if r["column_name"] and r["unreadable"] and not r["known"]:
            raise quality.QualityError(f"not numeric: {r['column_name']}, for example {r['example']!r}")
    total = sum(r["unreadable"] for r in report)
    if total > max_rejects:
        worst = max(report, key=lambda r: r["unreadable"])
        raise quality.QualityError(
            f"{total} unreadable cells, more than {max_rejects}: {worst['unreadable']} in {worst['column_name'] or 'broken records'}, for example {worst['example']!r}"
        )


def ingest_flows(spark: SparkSession, source: str, target: str, fmt: str | None = None, max_rejects: int = 0) -> DataFrame:
    """Reads flows once, writes them to ``target`` as ``store_flows`` does, and returns their reject report.

    The cells are counted while the rows pass to a typed copy in the checkpoint
    folder, so that text is only read once; the range split samples the copy. Raises
    ``SourceError`` when more cells than ``max_rejects`` are unreadable, and then
    leaves ``target`` as it was. Otherwise such cells are NULL there.
    """
    rows = read_with_rejects(spark, source, S.FLOW, fmt)
    seen = Observation("rejects")
    counts = [F.count(F.lit(1)).alias("records")]
    for c in (*S.FLOW_COLUMNS, ""):
        mine = _rejects_of(c)
        counts += [F.sum(F.size(mine)).alias(f"bad_{c}"), F.min(F.get(mine, 0)["cell"]).alias(f"cell_{c}")]
        counts.append((F.count(c) if c else F.lit(0).cast("long")).alias(f"known_{c}"))
    typed = written(rows.observe(seen, *counts).drop(REJECTS))
    found = seen.get
    report = [
        {"column_name": c, "records": found["records"], "known": found[f"known_{c}"], "unreadable": found[f"bad_{c}"] or 0, "example": found[f"cell_{c}"]}
        for c in (*S.FLOW_COLUMNS, "")
    ]
    try:
        _judge(report, max_rejects)
    except quality.QualityError as e:
        raise SourceError(str(e)) from e
    store_flows(typed, target)
    return spark.createDataFrame([tuple(r.values()) for r in report], "column_name string, records long, known long, unreadable long, example string")


def read_flows(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return _read(spark, path, S.FLOW, fmt)


def read_countries(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return _read(spark, path, S.COUNTRY, fmt)


def read_products(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return _read(spark, path, S.PRODUCT, fmt)


def store_flows(flows: DataFrame, path: str) -> None:
    """Writes flows for repeated analysis: a folder per year, ordered by origin within.

    The range split looks at all four keys, so one large origin or year spreads
    over many files; the order lets a reporter's filter skip most of each file.
    """
    (
        flows.repartitionByRange("t", "i", "j", "k")
        .sortWithinPartitions("t", "i", "j")
        .write.mode("overwrite")
        .partitionBy("t")
        .parquet(path)
    )


def drop_unknown(flows: DataFrame) -> DataFrame:
    """Flows with both value and quantity known."""
    return flows.na.drop(subset=["v", "q"])


def at_least(flows: DataFrame, min_value: float) -> DataFrame:
    """Flows worth ``min_value`` or more."""
    return flows.filter(F.col("v") >= F.lit(min_value))


def clean(flows: DataFrame, min_value: float = S.MIN_FLOW_VALUE) -> DataFrame:
    return at_least(drop_unknown(flows), min_value)


def enrich(flows: DataFrame, countries: DataFrame, products: DataFrame) -> DataFrame:
    """Flows with names of both ends and of the product.

    Left joins: an unknown code keeps its row with NULL names, a dimension key
    that occurs twice doubles its rows.
    """
    name = countries.select("country_code", "country_name", "country_iso3")
    origin = name.toDF("i", "exporter_name", "exporter_iso3")
    destination = name.toDF("j", "importer_name", "importer_iso3")
    return (
        flows.join(origin, "i", "left")
        .join(destination, "j", "left")
        .withColumn("k_str", codes.hs6(F.col("k")))
        .join(products.select(F.col("code").alias("k_str"), "description"), "k_str", "left")
        .select(*flows.columns, "exporter_name", "exporter_iso3", "importer_name", "importer_iso3",
                "k_str", "description")
    )


def derive(flows: DataFrame, hs2_mode: str = "padded") -> DataFrame:
    """Adds chapter, heading, unit value and the logarithms of value and quantity."""
    k, v, q = F.col("k"), F.col("v"), F.col("q")
    return flows.withColumns(
        {
            "hs2": codes.hs2(k, hs2_mode),
            "hs4": codes.hs4(k),
            "unit_value": numeric.unit_value(v, q),
            "log_value": numeric.clamped_log(v),
            "log_quantity": numeric.clamped_log(q),
        }
    )


def prepared_flows(data: TradeData, focal: int | None = None, hs2_mode: str = "padded") -> DataFrame:
    """Row-level table of the reporter's flows with names and derived columns."""
    return derive(enrich(touching(data.flows, focal), data.countries, data.products), hs2_mode)


def load(
    spark: SparkSession,
    flows: str,
    countries: str,
    products: str,
    *,
    fmt: str | None = None,
    min_value: float | None = None,
    drop_missing: bool = False,
    max_rejects: int | None = 0,
) -> TradeData:
    """Reads and checks the three tables.

    Text sources are scanned for cells that cannot be read: more than
    ``max_rejects`` of them are an error, and so is a column without any number;
    ``None`` leaves the scan out. ``ingest_flows`` does it while storing the flows.

    ``drop_missing`` and ``min_value`` select the stricter data set of the
    statistical reports; the plain reports use every row.  Raises
    ``SourceError`` when a path is missing, a table is empty or a column is
    absent or not numeric.
    """
    data = TradeData(
        read_flows(spark, flows, fmt), read_countries(spark, countries, fmt), read_products(spark, products, fmt)
    )
    try:
        quality.require_columns(data.flows, S.FLOW_COLUMNS)
        quality.require_columns(data.countries, S.COUNTRY_COLUMNS)
        quality.require_columns(data.products, S.PRODUCT_COLUMNS)
        quality.require_numeric(data.flows, S.FLOW_COLUMNS)
        raw, text = _opened(spark, flows, S.FLOW, fmt)
        if text and max_rejects is not None:
            _judge(reject_report(with_rejects(raw, S.FLOW)).collect(), max_rejects)
        for name, df in zip(data._fields, data):
            quality.require_rows(df, name)
    except quality.QualityError as e:
        raise SourceError(str(e)) from e
    flows_kept = data.flows
    if drop_missing:
        flows_kept = drop_unknown(flows_kept)
    if min_value is not None:
        flows_kept = at_least(flows_kept, min_value)
    return data._replace(flows=flows_kept)
