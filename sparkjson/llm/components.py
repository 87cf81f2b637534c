"""Connected components of a table of links, each labelled with its smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in ``links`` (two columns of ids); ids without a link do not appear.

    Each round every id takes the smallest label among its own and its neighbours', then the label of its label.
    Rounds end when nothing changes; each is written to the shared folder, so a lost executor costs one round.
    Nulls are ignored.  Self-links, repeated and reversed links are harmless.  No links: no rows.
    """
    a, b = (F.col(c) for c in links.columns)
    both = links.select(a.alias("id"), b.alias("to")).union(links.select(b.alias("id"), a.alias("to"))).where("id IS NOT NULL AND `to` IS NOT NULL")
    edges = materialize(both.distinct(), "edges")
    labels = materialize(edges.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("to"), "label"), "to").groupBy("id").agg(F.min("label").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = hooked.join(labels.select(F.col("id").alias("label"), F.col("label").alias("far")), "label", "left")
        fresh = materialize(jumped.select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        if fresh.where("old <> label").isEmpty():
            return fresh.select("id", "label")
        labels = fresh.select("id", "label")
