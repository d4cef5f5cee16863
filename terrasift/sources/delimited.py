"""Delimited text as all-string columns, with the rows' order kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from terrasift.functions.text import missing_to_null
from terrasift.operators.quality import require_columns


def header_name(name: str) -> str:
    return name.lstrip("﻿").strip().lower().replace(" ", "_")


def read_text(spark: SparkSession, path: str, required: list[str] | None = None, row: str | None = "row_idx") -> DataFrame:
    """A UTF-8 CSV with a header, quoted line breaks and doubled quotes. Cells that spell a missing value are NULL,
    nothing is inferred, header names are lower case with underscores. row names a column that grows with the row; with
    quoted line breaks a file is one partition, so it also is its order. A file is read by one task: many files are read in parallel, one large file isn't split."""
    options = {"header": "true", "multiLine": "true", "escape": '"', "encoding": "UTF-8"}
    raw = spark.read.options(**options, inferSchema="false").csv(path)
    schema = StructType([StructField(c, StringType()) for c in raw.columns])
    df = spark.read.options(**options, enforceSchema="true").schema(schema).csv(path).toDF(*(header_name(c) for c in raw.columns))
    require_columns(df, required or [])
    df = df.select(*(missing_to_null(F.col(c)).alias(c) for c in df.columns))
    return df.withColumn(row, F.monotonically_increasing_id()) if row else df


def write_text(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header each, over what was there. NULL is an empty cell."""
    df.write.mode("overwrite").options(header="true", escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def read_typed(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """What write_text wrote, with the columns and types of ddl: codes stay text, with their zeros."""
    kinds = StructType.fromDDL(ddl)
    text = read_text(spark, path, [f.name for f in kinds], row=None)
    return text.select(*((F.col(f.name) if isinstance(f.dataType, StringType) else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in kinds))
