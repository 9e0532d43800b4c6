"""Labelled vectors: libsvm, CSV and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_libsvm(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """``(label, features)`` from libsvm text; give the number of features to spare a pass over the data."""
    reader = spark.read.format("libsvm")
    if features is not None:
        reader = reader.option("numFeatures", str(features))
    return reader.load(path)


def write_libsvm(df: DataFrame, path: str) -> None:
    """Write ``(label, features)`` as libsvm text with one-based indices."""
    df.select(F.col("label").cast("double").alias("label"), "features").write.format("libsvm").save(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def assemble(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """``features`` from numeric columns, beside the columns to keep."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    return assembler.transform(df).select(*keep, "features")
