"""Connected components of a link table as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store


def components(store: Store, links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b): label is the smallest node it can reach.

    Each round takes the smallest label among neighbours and then follows the label's own label,
    so stars end after two rounds and chains after a number that grows with their logarithm.
    Rounds are written to the shared folder. An empty link table gives an empty result.
    """
    both = store.put(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = store.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "label")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label.node == near.a, "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = label.select(F.col("node").alias("via"), F.col("label").alias("further"))
        step = step.join(jump, step.label == jump.via, "left").select("node", "was", F.least("label", "further").alias("label"))
        step = store.put(step, "label")
        label = step.select("node", "label")
        if step.where(F.col("was") != F.col("label")).limit(1).count() == 0:
            return label


def merged_labels(store: Store, label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of components(...) after more links(a, b): only the labels that they join are walked."""
    of = lambda k: label.select(F.col("node").alias(k), F.col("label").alias(f"of_{k}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a != b")
    joined = components(store, between)
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    known = label.join(ends, "node", "full").select("node", F.coalesce("label", "node").alias("label"))
    of_label = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
    return store.put(known.join(of_label, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "label")
