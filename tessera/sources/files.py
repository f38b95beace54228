"""Documents, JSON lines and reports on files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import stable_locator
from ..operators.ingest import parse_documents


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc, locator, sha256, body (VARIANT) and error of YAML and JSON files; one that can't be read is a row with an error."""
    files = spark.read.format("binaryFile").load(path)
    return parse_documents(files).withColumn("locator", stable_locator(F.col("doc")))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of one JSON object a line; ones that don't fit the schema stop the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of a Markdown table, one a row."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
