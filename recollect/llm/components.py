"""Connected components of an edge table by minimum labels and pointer jumping, in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.plans.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, for the nodes of edges (a, b; longs, any direction).

    A round gives each node the least label among itself and its neighbours, then the label of that label. Each round's
    labels are checkpointed, so lineage stays short and lost executors cost a round at most. Nothing is gathered: a hub's
    neighbours meet in partial minima, and its label reaches them by a join that adaptive execution splits.

    Defined cases: links to oneself count for nothing; repeated links count once; an empty table gives an empty result;
    only a and b are read."""
    once = edges.select("a", "b").where("a <> b").distinct()
    both = cut(once.union(once.select("b", "a")))
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = step.alias("s").join(step.select(F.col("node").alias("p"), F.col("new").alias("pl")).alias("j"), F.col("s.new") == F.col("j.p"), "left")
        after = cut(jump.select("s.node", "s.label", F.least("s.new", F.coalesce("j.pl", "s.new")).alias("new")))
        changed = after.where(F.col("label") != F.col("new")).limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
