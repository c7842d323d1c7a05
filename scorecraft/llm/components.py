"""Connected components by minimum labels with pointer jumping; all state stays in stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over ``links`` (a, b), for every node that has a link.

    Each round a node takes the smallest label among itself and its neighbours,
    and its label's label; the number of rounds grows with the logarithm of
    the longest chain in practice.  A node with very many links is summed
    before the shuffle (minimum), and its join is one that Spark may split.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges = stored(both.distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = (edges.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("_c")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("_c").alias("_near")))
        step = labels.join(near, "node").select("node", F.col("comp").alias("_old"), F.least("comp", "_near").alias("_new"))
        # the label's own label, one jump
        jump = labels.select(F.col("node").alias("_new"), F.col("comp").alias("_jump"))
        step = stored(step.join(jump, "_new", "left").select(
            "node", "_old", F.least("_new", F.coalesce("_jump", "_new")).alias("comp")), "labels")
        labels = step.select("node", "comp")
        if not step.where("comp <> _old").limit(1).count():
            return labels
