"""Connected groups of a table of links, in DataFrame functions only.

Each node takes the smallest label among its neighbours' and its own, then the label of its label,
until nothing changes: the number of rounds grows with the logarithm of a chain's length. Each
round is a written table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstack.llm.common import drop, put


def components(links: DataFrame) -> DataFrame:
    """links (a, b: bigint) to (node, root): root is the group's smallest node."""
    both = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = put(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node", "left")
        step = step.select("node", "root", F.least("root", F.coalesce("m", "root")).alias("new"))
        # hook: what a root's members found becomes the root's own label
        hooks = step.groupBy("root").agg(F.min("new").alias("hook")).select(F.col("root").alias("node"), "hook")
        step = step.join(hooks, "node", "left").select("node", "root", F.least("new", F.coalesce("hook", "new")).alias("new"))
        step = put(step, "labels-step")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("next"))
        after = put(step.join(jump, "new", "left").select("node", "root", F.coalesce("next", "new").alias("new")), "labels")
        drop(step)
        moved = after.where("new <> root").limit(1).count()
        drop(labels)
        labels = after.select("node", F.col("new").alias("root"))
        if not moved:
            drop(both)
            return labels
