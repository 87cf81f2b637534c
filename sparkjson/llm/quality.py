"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``base_metrics`` counts words, symbols, repeated lines and repeated 5-word windows of a whole text.
``order_rules`` measures each rule's seconds and rejections on a sample and orders the rules by rejection
per cost, where a rule's rejections are those among the rows that the rules before it let pass; ``cascade`` is one
CASE expression in that order, so a row that one rule rejects is never looked at by the later, dearer ones.  Rules
take what the base metrics have counted already.  The verdict is the conjunction of all rules and does not depend
on the order.

Null and empty texts have no words: all counts are 0 and the base check fails them.  Repeated rows are judged
one by one.  Extra columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash inside one text.  A text whose windows are all different stops
    there; else the windows are sorted by hash, those equal to a neighbour are kept, and their places are
    folded into the number of words that they cover.
    """
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (window - 1)), lambda i: F.xxhash64(F.slice(tokens, i, window))
    )

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"]),
            )
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return F.aggregate(
                places,
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                lambda acc, p: F.struct(
                    (p + window).alias("end"), (acc["n"] + p + window - F.greatest(acc["end"], p)).alias("n")
                ),
                lambda acc: acc["n"],
            )

        return let(ordered, of)

    return F.when(
        F.size(tokens) > window,
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))),
    ).otherwise(0).cast("long")


def base_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Existing columns of these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    tokens = words(t)
    out = docs.withColumns(
        {
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": dup_lines(t),
            "__m": let(
                tokens,
                lambda w: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    repeat_words(w).alias("n_repeat_words"),
                ),
            ),
        }
    )
    out = out.withColumns({k: F.col("__m")[k] for k in ("n_words", "word_chars", "n_repeat_words")}).drop("__m")
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def counted(text: Column) -> dict[str, Column]:
    """The base metrics that ``RULES`` use, for a table that does not have them as columns."""
    return {
        "n_words": F.size(words(text)).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": dup_lines(text),
    }


@dataclass(frozen=True)
class Rule:
    """``fails`` makes a boolean column from the text column and the base metrics by name; null counts as not failed.

    ``cost`` is in seconds for the sample and ``rejects`` the share of the rows that earlier rules let pass.
    """

    name: str
    fails: Callable[[Column, Mapping[str, Column]], Column]
    cost: float = 0.0
    rejects: float = 0.0


#: Loose limits: they are meant for junk and leave ordinary prose alone.
RULES = (
    Rule("symbols", lambda t, m: m["n_symbols"] * 4 > m["n_words"]),
    Rule("capitals", lambda t, m: F.regexp_count(t, F.lit(r"\p{Lu}")) * 10 > F.regexp_count(t, F.lit(r"\p{L}")) * 6),
    Rule("letters", lambda t, m: F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) * 100 < F.length(t) * 40),
    Rule("lines", lambda t, m: m["n_dup_lines"] * 2 > F.size(F.split(t, "\n", -1))),
    Rule("long_words", lambda t, m: t.rlike(r"[^\x20\x09-\x0D]{1000}")),
)
METRICS = ("n_words", "n_symbols", "n_dup_lines")


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 2000, repeats: int = 3) -> list[Rule]:
    """``rules`` by rejection per cost, both measured on about ``sample_rows`` rows that pass the base check.

    The cost of a rule is the least of ``repeats`` timings less that of a job without a rule.  The sample only fixes
    the order of evaluation; every row gets the verdict of all rules.
    """
    total = docs.select(F.count(F.lit(1))).first()[0]
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    if total > sample_rows:
        sample = sample.sample(sample_rows / total, seed=7)
    sample = sample.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    sample = base_metrics(sample, "t").where(~F.col("base_failed")).select("t", *METRICS).persist(StorageLevel.MEMORY_AND_DISK)
    fails = [F.coalesce(r.fails(F.col("t"), {k: F.col(k) for k in METRICS}), F.lit(False)) for r in rules]

    def seconds(hit: Column) -> float:
        times = []
        for _ in range(repeats):
            began = time.perf_counter()
            sample.select(F.count_if(hit)).first()
            times.append(time.perf_counter() - began)
        return min(times)

    try:
        # How many rows of the sample fail which rules together; it has no more rows than the sample.
        joint = [(set(r["failed"]), r["count"]) for r in sample.select(_which(fails).alias("failed")).groupBy("failed").count().collect()]
        idle = seconds(F.col("t").isNull())
        cost = [max(seconds(f) - idle, 1e-4) for f in fails]
    finally:
        sample.unpersist()
    out, left = [], set(range(len(rules)))
    while left:
        rows = max(1, sum(n for _, n in joint))
        share = {k: sum(n for failed, n in joint if k in failed) / rows for k in left}
        best = max(left, key=lambda k: ((share[k] + 1e-6) / cost[k], -k))
        out.append(replace(rules[best], cost=cost[best], rejects=share[best]))
        joint = [(failed, n) for failed, n in joint if best not in failed]
        left.remove(best)
    return out


def _which(fails: Sequence[Column]) -> Column:
    """array<int>: the places of the conditions that hold."""
    return F.array_compact(F.array(*(F.when(f, F.lit(k)) for k, f in enumerate(fails)), F.lit(None).cast("int")))


def cascade(rules: Sequence[Rule], text: Column, metrics: Mapping[str, Column] | None = None) -> Column:
    """The name of the first rule, in the given order, that fails; null if none does.

    Without ``metrics`` they are counted from the text.
    """
    t, out = F.coalesce(text, F.lit("")), None
    m = counted(t) if metrics is None else metrics
    for rule in rules:
        out = (F if out is None else out).when(rule.fails(t, m), F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """Base metrics, ``base_failed`` and ``kept`` for every row; the cascade runs only where the base passed."""
    ordered = order_rules(docs, rules, text, sample_rows)
    first = cascade(ordered, F.col(text), {k: F.col(k) for k in METRICS})
    return base_metrics(docs, text).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(first.isNull()))


def op10_quality_rules(spark, sf_dir):
    from .common import documents

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality(documents(spark, sf_dir, "doc_id", "text")).select(*names)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 4)) AS i, ws FROM w WHERE len(ws) > 5),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM k),
c AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r WHERE n > 1),
p AS (SELECT doc_id, CAST(sum(CASE WHEN nx IS NULL THEN 5 ELSE least(5, nx - i) END) AS BIGINT) AS n FROM c GROUP BY doc_id),
m AS (SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
      FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 4 > n_words
       OR length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) * 10 > length(regexp_replace(t, '[^\p{L}]+', '', 'g')) * 6
       OR length(regexp_replace(t, '[^\p{L}]+', '', 'g')) * 100 < length(t) * 40
       OR n_dup_lines * 2 > len(string_split(t, chr(10)))
       OR regexp_matches(t, '[^\x20\x09-\x0D]{1000}')) AS kept
FROM b
"""
