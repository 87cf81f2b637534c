"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own content says so: after a full stop, line end or similar once a chunk has
``MIN_CHUNK`` characters, and at ``MAX_CHUNK`` at the latest.  Equal texts get equal chunks.  Chunks travel as
(64-bit id, SHA-256); an id is verified when every chunk that has it has one digest, else its digest stands in for it.  A document becomes its recipe, the ordered list of chunk identifiers, and documents
are equal when their recipes are.  The text itself is read once and never shuffled.  The few recipes that have more than
1 / HOT_SHARE of all rows each are broadcast to their rows, so no task gets all rows of a hot one.

Null counts as the empty text, whose recipe is the empty list.  Repeated rows (same doc_id) count one by one.  Other
columns are not read; an empty table gives no rows; a very long text is a long recipe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, documents, materialize

MIN_CHUNK, MAX_CHUNK, HOT_SHARE = 1024, 8192, 200
#: A chunk ends at the first boundary character after MIN_CHUNK characters.
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[.!?\n]|.{{1,{MAX_CHUNK}}}"


def chunks(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, recipe (array of identifiers), text_sha256 (of the normalised text)."""
    normal = docs.select(F.col(key).alias("key"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    marked = normal.select(
        "key",
        F.transform(chunks(F.col("t")), lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("sha"))).alias("cs"),
        F.unhex(F.sha2("t", 256)).alias("text_sha"),
        F.monotonically_increasing_id().alias("row"),
    )
    marked = materialize(marked, "recipes")
    # Ids with more than one digest: none is expected, and no number of them is assumed.
    seen = marked.select(F.explode("cs").alias("c")).groupBy("c.id").agg(F.min("c.sha").alias("lo"), F.max("c.sha").alias("hi"))
    bad = seen.where("lo <> hi").select("id")
    touched = (
        marked.select("row", F.explode("cs.id").alias("id")).join(bad, "id", "left_semi").groupBy("row").agg(F.collect_set("id").alias("bad"))
        if not bad.isEmpty()
        else None
    )
    plain = lambda c: F.hex(c["id"])
    if touched is None:
        recipe = F.transform("cs", plain)
    else:
        marked = marked.join(touched, "row", "left")
        recipe = F.transform(
            "cs", lambda c: F.when(F.array_contains(F.coalesce("bad", F.array().cast("array<bigint>")), c["id"]), F.hex(c["sha"])).otherwise(plain(c))
        )
    return marked.select(F.col("key").alias(key), recipe.alias("recipe"), F.lower(F.hex("text_sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keep_id (largest key of the equal texts), group_size, kept, text_sha256 for every row of ``docs``.

    Of rows that repeat the kept key itself, each counts as kept.  A null key loses to any other.
    """
    own = recipes(docs, key, text)
    groups = own.groupBy("recipe").agg(F.max(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "groups")
    is_hot = F.col("group_size") * HOT_SHARE > own.count()
    hot, rest = F.broadcast(groups.where(is_hot)), groups.where(~is_hot)  # fewer than HOT_SHARE hot ones
    joined = own.join(hot, "recipe").unionByName(own.join(hot.select("recipe"), "recipe", "left_anti").join(rest, "recipe"))
    return joined.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir, "doc_id", "text"))


OP7_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""
