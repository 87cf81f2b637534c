"""Substring dedup: every word inside a ``WINDOW``-word window that also starts earlier in the corpus goes.

Anchors of ``ANCHOR`` words are hashed only at places whose remainder modulo ``PERIOD`` is in the difference cover
``COVER``.  For any two places there is a shift below PERIOD that brings both onto the cover, and ANCHOR + PERIOD - 1 =
WINDOW, so two equal windows always share an aligned anchor.  Anchors that occur once rule out all windows around
them; the windows around shared anchors are extended to their full length and hashed whole, and of equal windows the
one that starts first stays.  A task compares its own windows first and sends each on once.

Anchor counts cover all documents.  Shared anchors travel to the texts as a bitmap of bounded size, which may let a
needless window pass but never loses one.  Windows are equal when their 96-bit hashes are (see wordhash): among
10**13 different windows two share one with a probability below 10**-3.  Earlier means smaller doc_id, or the same
doc_id and an earlier start.

Null or empty text: no words.  Rows that repeat a doc_id and its text are not repeats of each other; texts that share
a doc_id are told apart by ``sub``, a hash of the text that is 0 wherever a bitmap says that the doc_id has one text.  A row with a null doc_id
takes no part and is kept whole.  Texts of fewer than WINDOW words are kept whole.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, documents, materialize
from .wordhash import bitmap_of, mix, steps

WINDOW, ANCHOR, PERIOD, COVER = 20, 8, 13, (0, 1, 3, 9)


def _anchors(words) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the stretch) of all anchors of texts with a whole window, and their hashes."""
    doc, place = words.place()
    size = np.diff(words.at)[doc]
    at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (place + ANCHOR <= size) & (size >= WINDOW))
    return at, words.windows(ANCHOR)[at]


def shared_anchors(docs: DataFrame) -> DataFrame:
    """Anchor hashes that occur twice or more in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in steps(batch.column(0), batch.column(1)):
                hashes, n = np.unique(_anchors(words)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["anchor", "n"])

    counts = docs.mapInArrow(run, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n"))
    return counts.where("n > 1").select("anchor")


#: Windows that a task gathers before it compares them among themselves, and rows that a result holds at once.
AT_ONCE, ROWS = 500_000, 512
_COLUMNS = ("w", "v", "key", "sub", "start", "more")


def _first_and_later(w: np.ndarray, v: np.ndarray, key: np.ndarray, sub: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Of equal windows (w and v) the first (of each text), with ``more`` 0; the later ones, known to be repeats, as runs of ``more`` windows."""
    order = np.lexsort((sub, start, key, v, w))
    w, v, key, sub, start = w[order], v[order], key[order], sub[order], start[order]
    same = (w[1:] == w[:-1]) & (v[1:] == v[:-1])
    group = np.flatnonzero(np.concatenate([[True], ~same]))
    first = np.repeat(group, np.diff(np.append(group, len(w))))
    later = (key != key[first]) | (start != start[first])
    once = ~later  # rows that repeat a key and its text are one place
    once[1:] &= ~same | (sub[1:] != sub[:-1])
    k, u, s = key[later], sub[later], start[later]
    order = np.lexsort((s, u, k))
    k, u, s = k[order], u[order], s[order]
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]) | (u[1:] != u[:-1]) | (s[1:] > s[:-1] + 1)
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(k))[: len(at)] - 1
    runs, zero = mix(k[at].astype(np.uint64) + s[at].astype(np.uint64)), np.zeros(len(at), np.int32)  # any value: it deals the runs out
    more = np.concatenate([np.zeros(int(once.sum()), np.int32), (s[last] - s[at] + 1).astype(np.int32)])
    pairs = ((w[once], runs), (v[once], zero), (key[once], k[at]), (sub[once], u[at]), (start[once], s[at]))
    joined = [np.concatenate(x) for x in pairs]
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in (*joined, more)], _COLUMNS)


def several_texts(docs: DataFrame):
    """A bitmap of the hashed keys that more than one text has."""
    hashes = docs.where("key IS NOT NULL").groupBy(F.xxhash64("key").alias("h")).agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    return bitmap_of(hashes.where("lo <> hi").select("h"), "several")


def _subs(several, key_hashes: np.ndarray, text_hashes: np.ndarray) -> np.ndarray:
    return np.where(several.has(key_hashes.view(np.uint64)), text_hashes, 0)


def candidate_windows(docs: DataFrame, bitmap, several) -> DataFrame:
    """(w, v, key, sub, start, more) of all windows that hold a shared anchor on the cover, after a task's own comparison.

    However often a window occurs, a task sends it on once (for each text of its first key), so no window's rows
    outnumber the tasks unless one key has many texts.  ``several``: broadcast bitmap of several_texts.
    """
    docs = docs.select("key", "text", F.xxhash64("key"), F.xxhash64("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            subs, row = _subs(several.value, *(batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))), 0
            for keys, words in steps(batch.column(0), batch.column(1)):
                own, row = subs[row : row + len(keys)], row + len(keys)
                at, hashes = _anchors(words)
                doc, place = words.place()
                size = np.diff(words.at)[doc]
                seen = np.zeros(len(doc) + PERIOD + 1, np.int32)
                seen[at[shared.value.has(hashes)] + 1] = 1
                seen = np.cumsum(seen)
                # An anchor at s..s+PERIOD-1 lies inside the window from s on, and so in the same text.
                first = np.arange(len(doc))
                ok = np.flatnonzero((seen[first + PERIOD] > seen[first]) & (place + WINDOW <= size))
                held.append((words.windows(WINDOW)[ok], (words.windows(WINDOW, 1)[ok] >> np.uint64(32)).astype(np.uint32).view(np.int32), keys[doc[ok]].astype(np.int64), own[doc[ok]], place[ok].astype(np.int32)))
                if sum(len(x[0]) for x in held) > AT_ONCE:
                    yield _first_and_later(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield _first_and_later(*map(np.concatenate, zip(*held, strict=True)))

    return docs.mapInArrow(run, "w long, v int, key long, sub long, start int, more int")


def repeated_windows(docs: DataFrame, several) -> DataFrame:
    """(key, sub, runs): array of struct(start, more) with all windows that also start earlier; ``docs``: (key long, text)."""
    docs = docs.where("key IS NOT NULL")
    windows = candidate_windows(docs, bitmap_of(shared_anchors(docs), "anchors"), several)
    first = F.min(F.when(F.col("more") == 0, F.struct("key", "start"))).over(Window.partitionBy("w", "v"))
    later = windows.withColumn("first", first).where((F.col("more") > 0) | (F.struct("key", "start") > F.col("first")))
    run = F.struct("start", F.greatest("more", F.lit(1)).alias("more"))
    return later.groupBy("key", "sub").agg(F.collect_set(run).alias("runs"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (long), n_words, n_removed and kept_text (kept words joined by one space) for every row of ``docs``.

    Only texts that a bitmap of the keys with repeats lets pass are joined with their runs; the others go straight on.
    """
    own = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    several = own.sparkSession.sparkContext.broadcast(several_texts(own))
    with batches_of(own.sparkSession, ROWS):
        repeats = materialize(repeated_windows(own, several), "repeats")
    touched = own.sparkSession.sparkContext.broadcast(bitmap_of(repeats.select(F.xxhash64("key").alias("h")), "touched"))
    hashed = own.select("key", "text", F.xxhash64("key"), F.xxhash64("text"))

    def parts(batches: Iterator[pa.RecordBatch], hit: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Rows whose key may have repeats, or the others, with their ``sub``."""
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                key_hashes, text_hashes = (some.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
                ok = touched.value.has(key_hashes.view(np.uint64)) & some.column(0).is_valid().to_numpy(zero_copy_only=False)
                ok = ok if hit else ~ok
                yield some.filter(pa.array(ok)), _subs(several.value, key_hashes, text_hashes)[ok]

    def with_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, subs in parts(batches, True):
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(subs), some.column(1)], ["key", "sub", "text"])

    def result(keys: pa.Array, texts: pa.Array, runs: list) -> pa.RecordBatch:
        sizes, gone, kept = [], [], []
        for body, own_runs in zip(texts, runs, strict=True):
            words, cut = body.as_py().encode().split(), 0  # bytes split at just these separators
            sizes.append(len(words))
            if own_runs:
                edge = np.zeros(len(words) + 1, np.int32)
                start, more = (np.array([r[x] for r in own_runs]) for x in ("start", "more"))
                np.add.at(edge, start, 1)
                np.add.at(edge, start + (WINDOW - 1 + more), -1)
                stay = np.cumsum(edge)[:-1] == 0
                cut = len(words) - int(stay.sum())
                words = [words[i] for i in np.flatnonzero(stay)]
            gone.append(cut)
            kept.append(b" ".join(words).decode())
        return pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["key", "n_words", "n_removed", "kept_text"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _ in parts(batches, False):
            yield result(some.column(0), some.column(1), [None] * len(some))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                yield result(some.column(0), some.column(1), some.column(2).to_pylist())

    schema = "key long, n_words long, n_removed long, kept_text string"
    joined = hashed.mapInArrow(with_repeats, "key long, sub long, text string").join(repeats, ["key", "sub"], "left").select("key", "text", "runs")
    return joined.mapInArrow(reduced, schema).unionByName(hashed.mapInArrow(whole, schema)).withColumnRenamed("key", key)


def op9_substring_dedup(spark, sf_dir):
    out = remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM d WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS w FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM k),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM r WHERE n > 1),
p AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id),
f AS (SELECT d.doc_id, ws, coalesce(ps, []) AS ps FROM d LEFT JOIN p ON d.doc_id = p.doc_id),
x AS (SELECT doc_id, ws, len(ps) AS gone FROM f),
u AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, ws FROM d),
v AS (SELECT u.doc_id, string_agg(ws[u.i], ' ' ORDER BY u.i) AS t FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.p = u.i WHERE g.p IS NULL GROUP BY u.doc_id)
SELECT x.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(coalesce(v.t, '')) AS kept_sha256
FROM x LEFT JOIN v ON x.doc_id = v.doc_id
"""
