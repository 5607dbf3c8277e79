"""Connected components of an edge table, by rounds of smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import stored

MAX_ROUNDS = 100


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b); ``label`` is the smallest node of the component.

    Each round takes the smallest label among a node and its neighbours, combined before the shuffle so that a node with very many
    neighbours is no burden, then jumps to the label's own label. Rounds end when no label changes; each is a written table.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        merged = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        roots = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = merged.join(roots, merged["label"] == roots["_n"]).select("node", "old", F.least("label", "_l").alias("label"))
        jumped = stored(jumped, "labels")
        labels = jumped.select("node", "label")
        if not jumped.where("label <> old").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
