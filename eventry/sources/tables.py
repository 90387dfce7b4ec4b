"""Scans and sinks (S01-S08). All go through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, schema=None) -> DataFrame:
    """A Parquet table; columns it lacks are an error. A declared schema saves the footer scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a declared schema."""
    return spark.read.csv(path, header=True, schema=schema)


def sink_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """S03."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def sink_clustered(df: DataFrame, name: str, path: str, by: list[str], order: list[str], buckets: int) -> DataFrame:
    """S03 as a table in buckets by ``by``, sorted inside: windows and joins by these columns read it without a shuffle. Returns the table."""
    df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *by).sortBy(*by, *order).saveAsTable(name)
    return df.sparkSession.table(name)


def sink_csv(df: DataFrame, path: str) -> None:
    """S04."""
    df.write.mode("overwrite").csv(path, header=True)


def sink_json(df: DataFrame, path: str) -> None:
    """S05."""
    df.write.mode("overwrite").json(path)


def append_manifest(df: DataFrame, name: str, path: str, manifest: str, gate: str = "pass") -> None:
    """One row on an artifact (rows, columns, gate) at the end of the manifest table."""
    row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("artifact"), F.lit(path).alias("path"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(gate).alias("gate"), F.current_timestamp().alias("written_at"))
    row.write.mode("append").parquet(manifest)


def scan_events(spark: SparkSession, path: str, required: list[str], order: list[str] | None = None) -> DataFrame:
    """An event table that has the required columns, with its place in the file as the last tie-breaker.

    With ``order`` the columns given must be a total order and are packed as the order; else a row's place is its file and its number in it, which stay
    the same however the scan is split.
    """
    df = spark.read.parquet(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    place = F.struct(*order) if order else F.struct("_metadata.file_path", "_metadata.row_index")
    return df.withColumn("ingest_order", place)


def sink_vectors(df: DataFrame, key_cols: list[str], vec_col: str, path: str) -> None:
    """Vectors as float arrays with their key in the row, so that nothing is aligned by position."""
    df.select(*key_cols, F.col(vec_col).cast("array<float>").alias(vec_col)).write.mode("overwrite").parquet(path)
