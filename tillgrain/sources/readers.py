"""Reading and validating invoice lines."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrain.sources.schemas import AMOUNT, INVOICE_LINES, RFM_REQUIRED
from tillgrain.sources.writers import write_parquet


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = INVOICE_LINES,
    encoding: str = "ISO-8859-1",
    timestamp_format: str = "M/d/yyyy H:mm",
) -> DataFrame:
    """CSV with a header, bound to the schema by column name; no inference pass.

    Columns of the schema that the header lacks are left out, so that the required-column
    check can name them.
    """
    options = {"header": True, "encoding": encoding, "escape": '"'}
    header = spark.read.options(**options).csv(path).columns
    known = {field.name: field for field in schema.fields}
    bound = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    return (
        spark.read.options(**options, timestampNTZFormat=timestamp_format, mode="FAILFAST")
        .schema(bound)
        .csv(path)
    )


def read_csv_with_rejects(
    spark: SparkSession,
    path: str,
    schema: T.StructType = INVOICE_LINES,
    encoding: str = "ISO-8859-1",
    timestamp_format: str = "M/d/yyyy H:mm",
    columns: Sequence[str] | None = None,
    required: Iterable[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The lines that can be read, typed, and those that cannot: (accepted, rejected).

    A line is rejected whole if it has too few or too many columns, if a value does not fit its
    type, or if one of the ``required`` columns is empty. ``rejected`` has ``line`` (the text as
    it stood), ``reasons`` (an array, in column order) and ``file``. Files without a header are
    read where ``columns`` names theirs. Both frames read the input; lines are parsed into types
    once, and only what fails is parsed again to say why.
    """
    options = {"header": columns is None, "encoding": encoding, "escape": '"', "timestampNTZFormat": timestamp_format}
    names = list(columns) if columns else spark.read.options(**options).csv(path).columns
    known = {field.name: field for field in schema.fields}
    bound = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in names])
    require_columns_named(names, required)
    corrupt = "_line"
    parsed = (
        spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt, columnPruning=False)
        .schema(T.StructType([*bound.fields, T.StructField(corrupt, T.StringType())]))
        .csv(path)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    as_text = T.StructType([*[T.StructField(c, T.StringType()) for c in names], T.StructField("_shape", T.StringType())])
    again = {k: v for k, v in options.items() if k not in ("header", "encoding")} | {"columnNameOfCorruptRecord": "_shape", "mode": "PERMISSIVE"}
    text = F.from_csv(corrupt, F.lit(as_text.toDDL()), {k: str(v) for k, v in again.items()})
    faults = [F.when(text["_shape"].isNotNull(), F.lit("number of columns"))]
    for field in bound.fields:
        given, value = text[field.name], F.col(field.name)
        if not isinstance(field.dataType, T.StringType):
            kind = field.dataType.simpleString()
            faults.append(F.when(text["_shape"].isNull() & given.isNotNull() & value.isNull(), F.lit(f"{field.name}: not {kind}")))
    missing = [F.when(F.col(c).isNull() & F.coalesce(text["_shape"].isNull() & text[c].isNull(), F.lit(True)), F.lit(f"{c}: missing")) for c in required]
    reasons = F.array_compact(F.array(*faults, *missing)) if required else F.array_compact(F.array(*faults))
    whole = F.coalesce(F.col(corrupt), F.to_csv(F.struct(*names), {"timestampNTZFormat": timestamp_format}))
    empty = reduce(Column.__or__, [F.col(c).isNull() for c in required], F.lit(False))
    bad = F.col(corrupt).isNotNull() | empty
    # always true, and so that every column is parsed: what nobody asks for would fail unseen
    read = F.hash(*names) >= -(2**31)
    accepted = parsed.filter(read & ~bad).select(*names)
    rejected = parsed.filter(read & bad).select(whole.alias("line"), reasons.alias("reasons"), F.col("_file").alias("file"))
    return accepted, rejected


def require_columns_named(names: Iterable[str], required: Iterable[str]) -> None:
    missing = sorted(set(required) - set(names))
    if missing:
        raise ValueError(f"missing columns in input: {', '.join(missing)}")


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    require_columns_named(df.columns, required)
    return df


def with_total_amount(df: DataFrame) -> DataFrame:
    """Derive TotalAmount where the input lacks it."""
    if "TotalAmount" in df.columns:
        return df
    return df.withColumn("TotalAmount", (F.col("Quantity") * F.col("UnitPrice")).cast(AMOUNT))


def validate(df: DataFrame, required: Iterable[str] = RFM_REQUIRED) -> DataFrame:
    return with_total_amount(require_columns(df, required))


def require_paths(spark: SparkSession, paths: dict[str, str]) -> None:
    """Fail once, naming every input that cannot be read."""
    missing = []
    for name, path in paths.items():
        try:
            spark.read.text(path).schema
        except AnalysisException:
            missing.append(f"{name}: {path}")
    if missing:
        raise FileNotFoundError("missing required inputs: " + "; ".join(missing))


def load_lines(
    spark: SparkSession, path: str, required: Iterable[str] = RFM_REQUIRED, **csv_options
) -> DataFrame:
    """Invoice lines from CSV, checked, with TotalAmount."""
    require_paths(spark, {"invoice lines": path})
    return validate(read_csv(spark, path, **csv_options), required)


def load_lines_with_rejects(
    spark: SparkSession, path: str, rejects: str, required: Iterable[str] = RFM_REQUIRED, **csv_options
) -> DataFrame:
    """Like ``load_lines``, but lines that cannot be read go to the Parquet table ``rejects``.

    Lines without an InvoiceNo are rejected too; nothing downstream could say what they belong to.
    """
    require_paths(spark, {"invoice lines": path})
    accepted, rejected = read_csv_with_rejects(spark, path, required=("InvoiceNo",), **csv_options)
    write_parquet(rejected, rejects)
    return validate(accepted, required)


def load_table(
    spark: SparkSession, path: str, required: Iterable[str] = RFM_REQUIRED
) -> DataFrame:
    """Invoice lines from Parquet, checked, with TotalAmount."""
    require_paths(spark, {"invoice lines": path})
    return validate(spark.read.parquet(path), required)
