"""Documents from files: Parquet, JSON lines, CSV or text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_documents(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    if kind not in ("parquet", "json", "csv", "text", "orc"):
        raise ValueError(f"no reader for {kind}")
    if kind == "csv":
        options = {"header": True, "inferSchema": True, **options}
    return spark.read.options(**options).format(kind).load(path)
