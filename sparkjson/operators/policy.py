"""Error policies: what becomes of rows whose JSON is invalid, and reports over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import minify
from ..functions.validity import repair_escapes, skip_invalid, validate

#: Which policy each error asks for, and how grave it is (0 info .. 3 fatal).
BY_ERROR = {
    "InvalidEscapeSequence": "repair", "InvalidUnicodeEscape": "repair", "InvalidCharacter": "drop", "InvalidNumber": "drop",
    "DepthLimitExceeded": "fail",
}
SEVERITY = {"DepthLimitExceeded": 3, "UnexpectedEndOfInput": 3, "UnterminatedObject": 3, "UnterminatedArray": 3, "UnterminatedString": 3}
POLICIES = ("fail", "drop", "repair", "skip", "keep")


def apply_policy(df: DataFrame, column: str, on_error: str | Callable[[Column], Column] = "keep", max_depth: int = 1000) -> DataFrame:
    """``df`` with ``error`` (struct or null) and the rows of invalid JSON treated.

    fail: the query fails with the error's name; drop: such rows go; repair: broken escapes are mended and the text
    checked again; skip: what is no lexeme is left out and the text checked again; keep: rows stay; a function: it makes the new text from the old, which is checked again.
    Null texts pass with no error.
    """
    c = F.col(column)

    def checked(frame: DataFrame) -> DataFrame:
        error = F.transform(F.array(validate(c, max_depth)), lambda e: F.when(~e["valid"], e))[0]
        # No filter passes a nondeterministic column, so one on the error does not validate each text once more.
        return frame.withColumn("error", F.when(F.monotonically_increasing_id() >= 0, error))

    menders = {"repair": repair_escapes, "skip": skip_invalid}
    if callable(on_error) or on_error in menders:
        mend = on_error if callable(on_error) else menders[on_error]
        first = checked(df)
        return checked(first.withColumn(column, F.when(F.col("error").isNotNull(), mend(c)).otherwise(c)).drop("error"))
    if on_error not in POLICIES:
        raise ValueError(f"on_error must be a function or one of {POLICIES}")
    out = checked(df)
    if on_error == "drop":
        return out.where("error IS NULL")
    if on_error == "fail":
        return out.withColumn(column, F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("Invalid JSON: "), F.col("error.error")))).otherwise(c))
    return out


def quarantine(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their error); both read the same plan."""
    out = apply_policy(df, column, "keep")
    return out.where("error IS NULL").drop("error"), out.where("error IS NOT NULL")


def severity(error: Column) -> Column:
    levels = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return F.when(error.isNotNull(), F.coalesce(levels[error], F.lit(2)))


def recommended_policy(error: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in BY_ERROR.items() for x in kv])[error], F.lit("keep"))


def error_report(df: DataFrame, column: str) -> DataFrame:
    """error_type, n, fatal, policy: how often each error occurs; valid and null texts are left out."""
    out = apply_policy(df.select(column), column).where("error IS NOT NULL").select(F.col("error.error").alias("error_type"))
    counts = out.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("error_type", "n", (severity(F.col("error_type")) >= 3).alias("fatal"), recommended_policy(F.col("error_type")).alias("policy"))


def resilient_minify(c: Column) -> Column:
    """Strict minification where the text is valid, else the lenient one."""
    return F.coalesce(minify(c, "eco"), minify(c, "sport"))
