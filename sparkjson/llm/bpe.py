"""Byte-level BPE with Spark's higher-order functions.

A word is its bytes (one character of ISO-8859-1 for each) and an array of its pieces' starts and pair ranks;
``fold_word`` folds ranked merges over it, looking pairs up in a rank map.  The map is dealt into buckets by hash, since Spark scans a map's keys in
order; it is a scalar subquery of one row, since the text of each plan, which the driver keeps, would hold a literal whole.  Distinct words are counted over the whole corpus, and the commonest ``DICTIONARY_WORDS`` of them are folded
once; texts look their words up in that dictionary, a scalar subquery of bounded size, and fold only the others (all
words of more than ``WORD_CHARS`` characters among them) in place.  So no text is shuffled, and what travels to the tasks does not grow with the corpus.

Decoding joins the pieces of the ids, as bytes.

Null text: empty, no ids.  Equal rows get equal results, rows without an id like any other; an empty table gives no rows;
a text that is nothing but white space is one or two words.  The fold is quadratic in the length of a single word without
any break.  Other columns are carried along and not read; one named ``ids`` is replaced.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, materialize

DICTIONARY_WORDS = 1 << 19
#: Longer words, in characters, are never held, which bounds the dictionary in bytes too.
WORD_CHARS = 128
#: Powers of two.
RANK_BUCKETS, DICTIONARY_BUCKETS = 1 << 16, 1 << 17
NO_RANK = 2**31 - 1


def java_pattern(pattern: str) -> str:
    """The split pattern with ``\\s`` and ``\\S`` as white space of Unicode, which Java's own are not."""
    out = pattern.replace(r"[^\s", r"[^\p{IsWhite_Space}")
    return out.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


class Vocabulary:
    """Ranks of a .tiktoken file: the rank map as a scalar subquery, pieces by id as literals."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        names = [(piece.decode("latin-1"), rank) for piece, rank in ranks.items()]
        # Spark's own hash deals the pieces, so that both sides agree.
        dealt = spark.createDataFrame(names, "piece string, rank int").select("piece", "rank", _bucket(F.col("piece"), RANK_BUCKETS).alias("b"))
        buckets: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
        for row in dealt.collect():
            buckets[row["b"]][row["piece"]] = row["rank"]
        pieces = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece.hex()
        row = spark.createDataFrame([(json.dumps(buckets),)], "ranks string")
        self.ranks = materialize(row.select(F.from_json("ranks", "array<map<string,int>>").alias("ranks")), "ranks").scalar()
        self.pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
        self.little_endian = F.from_json(F.lit(json.dumps([k.to_bytes(4, "little").hex() for k in range(len(pieces))])), "array<string>")

    def name(self, df: DataFrame) -> DataFrame:
        """``df`` with the rank map as ``__ranks``, once for ``ids``.

        Analysis wants subqueries outside of lambdas.  What is named once and used once, Catalyst puts back where it is
        used, so no row carries a copy.
        """
        return df.withColumn("__ranks", self.ranks)

    def ids(self, words: Column, known=None) -> Column:
        """array of array<int>: the ids of each of ``words``, for rows of ``name``; ``known(word)`` may have them already.

        The rank map is bound once, however often the fold looks into it.
        """

        def of(ranks: Column) -> Column:
            fold = lambda w: fold_word(ranks, w)
            return F.transform(words, fold if known is None else lambda w: F.coalesce(known(w), fold(w)))

        return let(F.col("__ranks"), of)


def _bucket(value: Column, buckets: int) -> Column:
    return F.hash(value).bitwiseAND(F.lit(buckets - 1))


def as_bytes(word: Column) -> Column:
    """The UTF-8 bytes of a string, one character each."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def fold_word(ranks: Column, word: Column) -> Column:
    """array<int>: the ids of one word; the leftmost pair of least rank is merged until no pair has a rank."""

    def rank(piece: Column) -> Column:
        return F.coalesce(F.get(ranks, _bucket(piece, RANK_BUCKETS))[piece], F.lit(NO_RANK))

    def fold(b: Column) -> Column:
        n = F.length(b)

        def low(code: Column) -> Column:
            return code.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")

        def pair(start: Column, end: Column) -> Column:
            """The rank of the piece ``start`` to ``end`` in the high bits, ``start`` in the low ones."""
            return F.shiftleft(rank(F.substr(b, start + 1, end - start)).cast("long"), 32) + start

        def merge(s: Column, at: Column) -> Column:
            """Merge the pieces ``at`` and ``at + 1`` (from 1), and rank the two pairs that this changes."""
            start = lambda k: low(F.get(s, k - 1))
            left = F.when(at > 1, F.array(pair(start(at - 1), start(at + 2)))).otherwise(F.array().cast("array<long>"))
            right = F.when(at + 2 < F.size(s), pair(start(at), start(at + 3))).otherwise(last + start(at))
            return F.flatten(F.array(F.slice(s, F.lit(1), F.greatest(at - 2, F.lit(0))), left, F.array(right), F.slice(s, at + 2, F.size(s))))

        def step(s: Column, _: Column) -> Column:
            # The leftmost pair of least rank: of equal ranks the least start.  Most words are done long before the last step.
            return let(F.array_min(s), lambda m: F.when(m >= last, s).otherwise(let(F.array_position(s, m).cast("int"), lambda at: merge(s, at))))

        # One number for each piece: where it starts, and the rank of what it makes with the next; the end closes the array.
        last = F.lit(NO_RANK << 32)
        start = F.concat(F.transform(F.sequence(F.lit(0), n - 2), lambda i: pair(i, i + 2)), F.array(last + n - 1, last + n))
        done = F.aggregate(F.sequence(F.lit(2), n), start, step)

        def ids(s: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda i: let(low(F.get(s, i)), lambda k: rank(F.substr(b, k + 1, low(F.get(s, i + 1)) - k))))

        return let(done, ids)

    # All single bytes are in the vocabulary, so what is folded has two bytes or more.
    return let(as_bytes(word), lambda b: let(rank(b), lambda whole: F.when(whole != NO_RANK, F.array(whole)).otherwise(fold(b))))


def split_words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def dictionary(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", words: int = DICTIONARY_WORDS) -> DataFrame:
    """One row, one column: an array of DICTIONARY_BUCKETS maps word -> ids of the commonest words of all texts."""
    counts = docs.select(F.explode(split_words(F.col(text), pattern)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.where(F.length("word") <= WORD_CHARS), "words")
    top = 100_000
    sizes = {r["n"]: r["c"] for r in counts.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, held = top + 1, 0
    for n in sorted(sizes, reverse=True):
        if held + sizes[n] > words:
            break
        least, held = n, held + sizes[n]
    chosen = counts.where(F.col("n") >= least).repartition(4 * docs.sparkSession.sparkContext.defaultParallelism)
    folded = vocabulary.name(chosen).select("word", "n", vocabulary.ids(F.array("word"))[0].alias("ids"), _bucket(F.col("word"), DICTIONARY_BUCKETS).alias("b"))
    folded = materialize(folded, "dictionary")
    # Spark scans a map's keys in order, so the commonest words come first.
    common = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word", "ids")))
    maps = folded.groupBy("b").agg(F.map_from_entries(F.transform(common, lambda x: F.struct(x["word"], x["ids"]))).alias("m"))
    every = docs.sparkSession.range(DICTIONARY_BUCKETS).select(F.col("id").cast("int").alias("b")).join(maps, "b", "left")
    empty = F.create_map().cast("map<string,array<int>>")
    every = every.select("b", F.coalesce("m", empty).alias("m"))
    in_order = F.array_sort(F.collect_list(F.struct("b", "m")), lambda x, y: x["b"] - y["b"])
    return materialize(every.agg(F.transform(in_order, lambda x: x["m"]).alias("maps")), "maps")


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", words: int = DICTIONARY_WORDS) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), replacing a column of that name."""
    known = dictionary(docs, vocabulary, pattern, text, words).scalar()

    def look_up(word: Column) -> Column:
        return F.get(F.col("__known"), _bucket(word, DICTIONARY_BUCKETS))[word]

    named = vocabulary.name(docs.withColumn("__known", known))  # as ``name`` says, no row carries the dictionary
    return named.withColumn("ids", F.flatten(vocabulary.ids(split_words(F.col(text), pattern), look_up))).drop("__known", "__ranks")


def decode(vocabulary: Vocabulary, ids: Column) -> Column:
    """The bytes that ``ids`` stand for."""
    return F.unhex(F.array_join(F.transform(ids, lambda k: F.get(vocabulary.pieces, k)), ""))


def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers

    vocabulary = Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = encode(documents(spark, sf_dir, "doc_id", "text"), vocabulary, public_tokenizers.PATTERN)
    packed = F.unhex(F.array_join(F.transform("ids", lambda k: F.get(vocabulary.little_endian, k)), ""))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(packed, 256).alias("ids_sha256"), F.sha2(decode(vocabulary, F.col("ids")), 256).alias("decoded_sha256")
    )
