import hashlib
from collections import Counter, defaultdict

from cases import ascii_lower, empty, frame, rows, words
from pyspark.sql import functions as F

from sparkjson.llm.dedup import chunks, exact_dedup
from sparkjson.llm.quality import RULES, base_metrics, cascade, order_rules, quality


def test_exact_dedup_against_grouping(spark):
    groups = defaultdict(list)
    for r in rows():
        groups[ascii_lower(r[1])].append(r[0])
    want = Counter(
        (r[0], max(groups[t := ascii_lower(r[1])]), len(groups[t]), r[0] == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for r in rows()
    )
    assert Counter(map(tuple, exact_dedup(frame(spark)).collect())) == want


def test_exact_dedup_empty_and_null_ids(spark):
    assert exact_dedup(empty(spark)).collect() == []
    got = exact_dedup(frame(spark, with_null_id=True)).where("doc_id IS NULL").collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in got] == [(None, 1, True)]


def test_chunks_cover_the_text(spark):
    text = ("word " * 500 + ". ") * 20 + "\n" + "y" * 20000
    (row,) = spark.createDataFrame([(text,)], "t string").select(chunks(F.col("t")).alias("c")).collect()
    assert "".join(row.c) == text and len(row.c) > 5


def brute_metrics(text):
    ws, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    cover = {j for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(ws) < 10 or 100 * len(cover) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), failed


def test_quality_metrics_against_brute_force(spark):
    extra = [(900, "a | b | c | d | e | f | g | h | i | j | k", "en", None, 1), (901, "line one here\nline one here\n\nother", "en", None, 1)]
    docs = frame(spark).select("doc_id", "text", "kept").unionByName(spark.createDataFrame([(a, b, "x") for a, b, *_ in extra], "doc_id long, text string, kept string"))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in base_metrics(docs).collect())
    assert got == Counter((r[0], *brute_metrics(r[1])) for r in [*rows(), *extra])
    verdict = {r.doc_id: r.kept for r in quality(docs).collect()}
    assert verdict[300] and not verdict[900] and not verdict[402] and not verdict[1]
    assert quality(empty(spark)).collect() == []


def test_verdict_does_not_depend_on_the_order(spark):
    docs = frame(spark)
    ordered = order_rules(docs)
    assert {r.name for r in ordered} == {r.name for r in RULES}
    both = docs.select(cascade(ordered, F.col("text")).isNull().alias("a"), cascade(RULES[::-1], F.col("text")).isNull().alias("b"))
    assert both.where("a <> b").count() == 0
