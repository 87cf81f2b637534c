"""Counters over a run: sizes, ratios, errors; observed on the way or aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.lexical import minify, structure_counts
from ..functions.validity import is_valid

METRICS = ("documents", "input_bytes", "output_bytes", "errors")


def _sums(before: str, after: str) -> list:
    return [
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.octet_length(before)), F.lit(0)).alias("input_bytes"),
        F.coalesce(F.sum(F.octet_length(after)), F.lit(0)).alias("output_bytes"), F.count_if(F.col(before).isNotNull() & F.col(after).isNull()).alias("errors"),
    ]


def observed(df: DataFrame, before: str, after: str, name: str = "json") -> tuple[DataFrame, Observation]:
    """``df`` whose first action also fills an Observation with METRICS, without a pass of its own."""
    seen = Observation(name)
    return df.observe(seen, *_sums(before, after)), seen


def run_summary(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: METRICS and the least, mean and largest ratio of output to input."""
    ratio = F.octet_length(after) / F.nullif(F.octet_length(before), F.lit(0))
    return df.agg(*_sums(before, after), F.min(ratio).alias("ratio_min"), F.avg(ratio).alias("ratio_avg"), F.max(ratio).alias("ratio_max"))


def structure_totals(df: DataFrame, column: str) -> DataFrame:
    """One row: structure counts over all documents and the number of invalid ones."""
    counted = df.select(structure_counts(F.col(column)).alias("s"), is_valid(F.col(column)).alias("ok"))
    names = ("objects", "arrays", "strings", "numbers", "booleans", "nulls", "bytes")
    return counted.agg(*[F.coalesce(F.sum(f"s.{n}"), F.lit(0)).alias(n) for n in names], F.count_if(~F.col("ok")).alias("invalid"))


def prometheus_text(metrics: dict[str, float], prefix: str = "sparkjson") -> str:
    """Text exposition of a metrics row."""
    return "".join(f"# TYPE {prefix}_{k} gauge\n{prefix}_{k} {v}\n" for k, v in metrics.items())


def sampled(df: DataFrame, rate: float = 0.1, seed: int = 0) -> DataFrame:
    return df.sample(rate, seed=seed)


def minify_with_metrics(df: DataFrame, column: str, mode: str = "sport") -> DataFrame:
    out = df.withColumn("minified", minify(F.col(column), mode))
    return out.withColumns({"input_bytes": F.octet_length(column), "output_bytes": F.octet_length("minified")})
