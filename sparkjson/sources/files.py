"""File scans and sinks over Spark's text source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexical import minify
from ..functions.validity import validate


def read_documents(spark: SparkSession, path: str, glob: str | None = None, include: str | None = None, exclude: str | None = None, recursive: bool = True) -> DataFrame:
    """path, json: whole files, chosen by a glob on names and regular expressions on paths."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    out = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    out = out.where(F.col("path").rlike(include)) if include else out
    return out.where(~F.col("path").rlike(exclude)) if exclude else out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, json: one document per line."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def write_documents(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def minified_files(spark: SparkSession, source: str, mode: str = "sport", glob: str | None = None, fail_on_error: bool = False) -> DataFrame:
    """path, json, ok of every file below ``source``; json is null where a strict mode finds it invalid, or the query fails there."""
    out = read_documents(spark, source, glob).select("path", minify(F.col("json"), mode).alias("json"))
    if fail_on_error:
        failed = F.raise_error(F.concat(F.lit("Invalid JSON: "), F.col("path"))).cast("string")
        out = out.withColumn("json", F.coalesce("json", failed))
    return out.withColumn("ok", F.col("json").isNotNull())


def validated_files(spark: SparkSession, source: str, glob: str | None = None, max_depth: int = 1000) -> DataFrame:
    """path, valid, error, offset, line, column of every file below ``source``."""
    checked = read_documents(spark, source, glob).select("path", validate(F.col("json"), max_depth).alias("v"))
    return checked.select("path", "v.*")


def minify_files(spark: SparkSession, source: str, target: str, mode: str = "sport", glob: str | None = None) -> None:
    """Minify every file below ``source`` into text files below ``target``; invalid ones in a strict mode are left out.

    ``minified_files`` keeps each file's path.
    """
    write_documents(minified_files(spark, source, mode, glob).where("ok"), "json", target)


def write_metrics(df: DataFrame, path: str) -> None:
    """Append rows of metrics as JSON lines."""
    df.write.mode("append").json(path)
