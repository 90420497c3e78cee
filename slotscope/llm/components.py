"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotscope.llm.durable import stored

#: Links (two identifiers, 16 bytes each) that one task takes in; fewer than that need no shuffle.
PER_TASK = 200_000


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Every round takes the smallest label among the neighbours and then the label's own label, so
    chains shrink by half or more; labels are written out each round. No links give no rows; links
    with a null end are left out; repeated links and loops change nothing. The links are counted
    and held in one partition for each PER_TASK of them: a single one is joined without a shuffle.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b")
    edges, _ = stored(both.distinct())
    tasks = -(-edges.count() // PER_TASK) or 1
    edges = edges.coalesce(tasks)
    labels, path = stored(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        labels = labels.coalesce(tasks)
        near = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("lower"))
        jump = labels.select(F.col("a").alias("lower"), F.col("label").alias("jump"))
        after, path = stored(lower.join(jump, "lower").select("a", "label", F.least("lower", "jump").alias("new")), path)
        labels = after.select("a", F.col("new").alias("label"))
        if after.where("new < label").isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
