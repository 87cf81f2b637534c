"""Helpers shared by the operators: scratch tables on the shared folder and ASCII lower-casing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexical import let  # noqa: F401
from ..scratch import scratch_path

#: Word separators of the contracts: space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for all that is written or collected inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` does the same whenever each non-ASCII character is one that it leaves alone, which the
    Latin-1 lower-case letters are; other texts take the slower character map.
    """
    fast = (F.octet_length(text) == F.length(text)) | ~text.rlike(r"[^\x00-\x7Fß-öø-ÿ]")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(fast, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df
