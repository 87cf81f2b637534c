"""N-gram Jaccard self-join by token-combination prefixes, with connected components of the links.

A document is the set of its distinct ``NGRAM``-word shingles.  Documents with equal sets form a class, and classes are
joined.  A class is known by the 128-bit fingerprint of its set.  Its 64-bit id mixes the fingerprint with the class's smallest key, so texts that share a key
stay apart and one text stands for each class; ids are checked to be distinct, and mixed anew if they are not.  The tokens of a set are put in one global order: of the hash range below ``LOW`` first the rare ones (in fewer
than ``FREQUENT`` documents of all), then the frequent ones, then the rest of the hash range.  Of two sets with Jaccard
at least t, the first n - ceil(t n) + K tokens of each share K or more.  Hence the index:

* the rare tokens of the prefix for K = 1, each for itself;
* if that prefix holds other tokens, it is extended to K = m + 1, with m classes of frequent tokens.  Of m + 1 shared
  frequent tokens two fall in one class, so all pairs of frequent tokens of a class are indexed; m grows with
  the set's size, which keeps their number in proportion to it.  Tokens beyond LOW stand for themselves.

m depends on the size's power of two; a set is indexed for its own and for that of the largest partner it may have.

A bitmap of bounded size tells which keys two classes share; it has no false negatives.  Keys that few classes share
give pairs; keys that many share would give them all, so the classes around such keys form clusters, which are compared
in blocks inside tasks that return only links between parts not yet joined.  Either way a parity bitmap (a bit for
each token, whose Hamming distance never exceeds the sets' difference) refuses most pairs, and the rest are
verified on whole sets.

Null text, empty text or no words: no set, size 0, linked with nothing.  Texts of fewer than NGRAM words: the whole
sequence is the one token.  Ties and repeated rows: rows with equal sets are linked.  Rows with a null key get themselves
as component (null).  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, documents, materialize
from .components import components
from .wordhash import Bitmap, Words, bitmap_of, mix, steps

LOW, FREQUENT, HOT, BLOCK_TOKENS, BLOCK_SETS = 0.3, 16, 32, 500_000, 2048
#: Rows of an Arrow batch: texts, or pairs with two whole sets.
BATCH_ROWS = 512
_Q = 0xC2B2AE3D27D4EB4F


def token_sets(words: Words, ngram: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a stretch."""
    hashes, at, out = words.windows(ngram), words.at, []
    sizes = np.diff(at)
    whole = {}
    for n in range(1, ngram):
        short = np.flatnonzero(sizes == n)
        if len(short):
            whole |= dict(zip(short.tolist(), words.windows(n)[at[short]], strict=True))
    for k, n in enumerate(sizes.tolist()):
        if n >= ngram:
            out.append(np.unique(hashes[at[k] : at[k] + n - ngram + 1]))
        else:
            out.append(np.array([whole[k]] if n else [], np.uint64))
    return out


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a whole set, as two signed longs."""
    out = [0, 0]
    for lane, seed in enumerate((0x51ED270B3A9F1C65, 0x2545F4914F6CDD1D)) if len(tokens) else ():
        x = np.array([mix(tokens ^ np.uint64(seed)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)
        out[lane] = int(mix(x).view(np.int64)[0])
    return out[0], out[1]


def level(n: int) -> int:
    return n.bit_length() - 1


def classes_of(lv: int) -> int:
    """Number of classes of frequent tokens for sets of 2**lv and more tokens."""
    return max(1, (1 << lv) // 32)


class Index:
    """Index keys of a set for a threshold of ``num``/``den``; ``frequent`` is a bitmap of mixed token hashes."""

    def __init__(self, num: int, den: int, frequent: Bitmap):
        self.num, self.den, self.frequent = num, den, frequent
        self.low = np.uint64(int(LOW * 2**64))

    def prefix(self, n: int, shared: int) -> int:
        return min(n, n - -(-self.num * n // self.den) + shared)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if n * (self.den - self.num) < self.num:  # no other set can be that similar
            return np.zeros(0, np.uint64)
        # tokens are sorted by hash: below LOW, then the rest
        cut = int(np.searchsorted(tokens, self.low))
        common = self.frequent.has(mix(tokens[:cut]))
        rare = tokens[:cut][~common]
        first = self.prefix(n, 1)
        if len(rare) >= first:
            return rare[:first]
        order = np.concatenate([rare, tokens[:cut][common], tokens[cut:]])
        rank = np.zeros(n, np.int8)
        rank[len(rare) : cut], rank[cut:] = 1, 2
        out = [rare]
        for lv in {level(n), level(self.den * n // self.num)}:
            m = classes_of(lv)
            size = self.prefix(n, m + 1)
            out.append(order[:size][rank[:size] == 2])
            often = order[:size][rank[:size] == 1]
            group = mix(often) % np.uint64(m)
            for g in range(m):
                own = often[group == g]
                i, j = _pairs(len(own))
                out.append(mix(own[i] * np.uint64(_Q) + mix(own[j] + np.uint64(lv + 1))))
        return np.unique(np.concatenate(out))


@lru_cache(maxsize=512)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _sets(docs: DataFrame, ngram: int, schema: str, emit) -> DataFrame:
    """Run ``emit(keys, sets)`` -> arrays of ``schema`` for each stretch of ``docs`` (key, text)."""
    kinds = {x.split()[0]: {"long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in schema.split(", ")}
    names = [*kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, words in steps(batch.column(0), batch.column(1), lower=True):
                yield pa.RecordBatch.from_arrays([pa.array(x, kinds[n]) for n, x in zip(names, emit(keys, token_sets(words, ngram)), strict=True)], names)

    return docs.mapInArrow(run, schema)


def set_sizes(docs: DataFrame, ngram: int) -> DataFrame:
    """key, n, fp, fq (the fingerprint's halves) and text_hash of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for keys, words in steps(batch.column(0), batch.column(1), lower=True):
                sets = token_sets(words, ngram)
                prints = [fingerprint(s) for s in sets]
                columns = [keys, [len(s) for s in sets], [p for p, _ in prints], [q for _, q in prints]]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), batch.column(2).slice(at, len(keys))], ["key", "n", "fp", "fq", "text_hash"])
                at += len(keys)

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "key long, n long, fp long, fq long, text_hash long")


def frequent_tokens(docs: DataFrame, ngram: int) -> DataFrame:
    """Mixed hashes of the tokens below LOW that are in FREQUENT documents or more."""
    low = np.uint64(int(LOW * 2**64))

    def emit(_, sets):
        tokens, n = np.unique(np.concatenate([s[: np.searchsorted(s, low)] for s in sets]), return_counts=True)
        return mix(tokens).view(np.int64), np.minimum(n, FREQUENT).astype(np.int32)

    counts = _sets(docs, ngram, "token long, n int", emit).groupBy("token").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= FREQUENT).select("token")


def index_rows(docs: DataFrame, ngram: int, index, only=None) -> DataFrame:
    """(k, fp): mixed index keys of the sets; ``only``: broadcast Bitmap that the keys have to pass.

    Half a fingerprint is enough here: classes that share it are all taken for candidates.
    """

    def emit(_, sets):
        ks, fps = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        done = set()
        for s in sets:
            fp = fingerprint(s)[0]
            if fp in done:
                continue
            done.add(fp)
            k = mix(index.value.keys(s))
            if only is not None:
                k = k[only.value.has(k)]
            ks.append(k)
            fps.append(np.full(len(k), fp, np.int64))
        return np.concatenate(ks).view(np.int64), np.concatenate(fps)

    return _sets(docs, ngram, "k long, fp long", emit)


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """One bit for each of about as many places as there are tokens: whether an odd number of tokens falls there."""
    size = 1 << max(6, len(tokens).bit_length())
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A parity bitmap (or rows of them) of fewer words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _far(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    words = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum())


def most_difference(total, num: int, den: int):
    """Largest symmetric difference of two sets of ``total`` tokens together that are similar enough."""
    return total - 2 * -(-num * total // (num + den))


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def block_links(rows: list[tuple[int, np.ndarray]], num: int, den: int, apart: list[int]) -> list[tuple[int, int]]:
    """Links that join all similar sets of ``rows`` (id, tokens), leaving out those inside what is joined already.

    ``apart``: the block of each row; if there are two blocks, only pairs across are compared.
    """
    order = sorted(range(len(rows)), key=lambda k: len(rows[k][1]))
    rows, apart = [rows[k] for k in order], np.array([apart[k] for k in order])
    sizes = np.array([len(t) for _, t in rows])
    across = len(set(apart.tolist())) > 1
    bits = [parity_bits(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out, matrices = [], {}
    for i in range(len(rows)):
        end = int(np.searchsorted(sizes, den * sizes[i] // num, "right"))
        if end <= i + 1:
            continue
        words = len(bits[i])
        if words not in matrices:
            # sets of this size and up to the largest partner of any of them
            last = int(np.searchsorted(sizes, den * (words * 64) // num, "right"))
            matrices[words] = (i, np.stack([fold(b, words) for b in bits[i:last]]))
        base, matrix = matrices[words]
        near = np.bitwise_count(matrix[i + 1 - base : end - base] ^ bits[i]).sum(1, dtype=np.int64)
        ok = near <= most_difference(sizes[i] + sizes[i + 1 : end], num, den)
        if across:
            ok &= apart[i + 1 : end] != apart[i]
        at = np.flatnonzero(ok)
        for j in (at[np.argsort(near[at], kind="stable")] + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b and similar(rows[i][1], rows[j][1], num, den):
                parent[b] = a
                out.append((rows[i][0], rows[j][0]))
    return out


def _cluster_links(members: DataFrame, details: DataFrame, num: int, den: int) -> DataFrame:
    """Links inside clusters; ``members``: (cluster, id).  Blocks of bounded size meet in pairs."""
    own = members.join(details.select("id", "n", "tokens"), "id")
    size = own.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"))
    dealt = own.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "tokens")

    def run(table: pa.Table) -> pa.Table:
        rows = [(k, np.frombuffer(t, np.uint64)) for k, t in zip(table["id"].to_pylist(), table["tokens"].to_pylist(), strict=True)]
        links = block_links(rows, num, den, table["block"].to_pylist())
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return met.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def _pair_links(pairs: DataFrame, details: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar: parity bitmaps first, whole sets for what passes."""
    bits = details.select("id", "n", "bits")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            total = (x["na"].to_numpy() + x["nb"].to_numpy())
            far = np.array([_far(p, q) for p, q in zip(x["pa"].to_pylist(), x["pb"].to_pylist(), strict=True)], np.int64)
            yield x.select(["a", "b"]).filter(pa.array(far <= most_difference(total, num, den)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = [
                similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), num, den)
                for p, q in zip(x["ta"].to_pylist(), x["tb"].to_pylist(), strict=True)
            ]
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_bits = pairs.join(bits.toDF("a", "na", "pa"), "a").join(bits.toDF("b", "nb", "pb"), "b")
    sifted = materialize(with_bits.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(sift, "a long, b long"), "sifted")
    tokens = details.select("id", "tokens")
    with_sets = sifted.join(tokens.toDF("a", "ta"), "a").join(tokens.toDF("b", "tb"), "b")
    return with_sets.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", ngram: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """key, n_shingles, class_id (smallest key with the same set), component_id (smallest key) for every row of ``docs``.

    Beside them text_hash (xxhash64 of the text) and group_id, which differs even where two components have the same
    smallest key; it is null for rows that are linked with nothing by rule (no set or no key).  Linked: den * intersection >= num * union.
    """
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _components(own, key, ngram, num, den)


def _components(own: DataFrame, key: str, ngram: int, num: int, den: int) -> DataFrame:
    spark = own.sparkSession
    sizes = materialize(set_sizes(own, ngram), "sizes")
    classes = sizes.where("n > 0 AND key IS NOT NULL").groupBy("fp", "fq").agg(F.min("key").alias("class_id"), F.max("n").alias("n"))
    classes = materialize(classes, "classes")
    salt = next(k for k in range(64) if classes.groupBy(_class_id(k)).count().where("count > 1").isEmpty())
    classes = classes.withColumn("id", _class_id(salt))

    share = spark.sparkContext.broadcast
    index = share(Index(num, den, bitmap_of(frequent_tokens(own, ngram), "frequent")))
    keyed = own.where("key IS NOT NULL")
    shared = index_rows(keyed, ngram, index).groupBy("k").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    only = share(bitmap_of(shared.select("k"), "keys"))
    rows = index_rows(keyed, ngram, index, only).distinct().join(classes, "fp").select("k", "id", "n")
    rows = materialize(rows, "index")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("pivot"))

    small = rows.join(counts.where((F.col("c") > 1) & (F.col("c") <= HOT)).select("k"), "k")
    x, y = small.toDF("k", "a", "na"), small.toDF("k", "b", "nb")
    near = (F.col("a") < F.col("b")) & (den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    pairs = materialize(x.join(y, "k").where(near).select("a", "b").distinct(), "pairs")
    hot = rows.join(counts.where(F.col("c") > HOT).select("k", "pivot"), "k").select("id", "pivot").distinct()
    clusters = components(hot).select(F.col("label").alias("cluster"), "id")

    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(clusters.select("id")).distinct()
    chosen = share(bitmap_of(wanted.join(classes, "id").select(F.xxhash64("class_id").alias("h")), "wanted"))
    details = materialize(_details(own, ngram, chosen, salt), "details")
    links = materialize(_pair_links(pairs, details, num, den).union(_cluster_links(clusters, details, num, den)), "links")
    label = components(links)
    least = label.join(classes.select("id", "class_id"), "id").groupBy("label").agg(F.min("class_id").alias("component"))
    named = classes.select("fp", "fq", "id", "class_id").join(label.join(least, "label"), "id", "left")
    out = sizes.join(named, ["fp", "fq"], "left")
    alone = (F.col("n") == 0) | F.col("key").isNull()
    return out.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("key")).otherwise(F.coalesce("component", "class_id")).alias("component_id"),
        "text_hash",
        F.when(~alone, F.coalesce("label", "id")).alias("group_id"),
    )


def _class_id(salt: int) -> Column:
    return F.col("class_id").bitwiseXOR(F.col("fp")).bitwiseXOR(F.shiftleft("fq", salt)).alias("id")


def _details(docs: DataFrame, ngram: int, chosen, salt: int) -> DataFrame:
    """(id, n, bits, tokens) of the documents that ``chosen`` lets pass; only those with their class's smallest key have its id."""
    kept = docs.where("key IS NOT NULL").withColumn("h", F.xxhash64("key"))
    names = ["id", "n", "bits", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = chosen.value.has(batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
            batch = batch.filter(pa.array(ok))
            for keys, words in steps(batch.column(0), batch.column(1), lower=True):
                sets = token_sets(words, ngram)
                prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys ^ prints[:, 0] ^ (prints[:, 1] << salt)), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity_bits(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names,
                )

    return kept.mapInArrow(run, "id long, n long, bits binary, tokens binary")


def op1_ngram_jaccard(spark, sf_dir):
    return ngram_components(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_shingles", "component_id", "class_id")
