"""Connected components of an edge list, by least labels and shortcuts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Stages


def components(edges: DataFrame, stages: Stages, nodes: int | None = None) -> DataFrame:
    """(node, label) for every node of ``edges`` (a long, b long); the label is the least node reachable.

    Each round takes the least label among neighbours (aggregated map-side, so a hub with
    many edges costs its partition one row per task) and then the label's own label, which
    halves the way to the root. It ends when nothing changes. ``nodes`` bounds their number.
    """
    both = stages.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b"))
    labels = stages.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), nodes)
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("to"))
        roots = labels.select(F.col("node").alias("to"), F.col("label").alias("up"))
        new = stages.keep(step.join(roots, "to", "left").select("node", "old", F.least("to", F.coalesce("up", "to")).alias("label")), nodes)
        changed = new.where("label <> old").limit(1).count()
        stages.drop(labels)
        labels = new
        if not changed:
            stages.drop(both)
            out = labels.select("node", "label")
            out._stage_path = labels._stage_path
            return out
