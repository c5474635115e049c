"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); nodes of one component have its lowest node as label.

    Each round takes the lowest label among the neighbours and then the label's own label, so that long chains
    shrink fast. Every round is written, lowest labels are taken before they are shuffled, and only the number of
    labels that changed comes to the driver.
    """
    both = space.stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = space.stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-0")
    step, changed = 0, 1
    while changed:
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near.hint("merge"), labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("low"))
        own = labels.select(F.col("node").alias("of"), F.col("label").alias("jump"))
        step += 1
        after = space.stage(
            low.join(own.hint("merge"), F.col("low") == F.col("of")).select("node", F.least("low", "jump").alias("label"), (F.least("low", "jump") != F.col("label")).alias("moved")),
            f"{name}-{step}")
        changed = after.where("moved").count()
        space.drop(f"{name}-{step - 1}")
        labels = after.drop("moved")
    space.drop(f"{name}-links")
    return labels
