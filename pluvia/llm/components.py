"""Connected components of an edge table, by minimum labels with pointer jumping.

Every round is two joins and a pre-aggregated minimum, so a node with very many edges
does not gather in one task; each round is written to the shared folder. Labels and edges
never reach the driver, which sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import materialise, release


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component): the smallest node it reaches.

    Nodes without edges are not listed; loops and repeated edges do no harm. The result's
    attribute scratch is what `release` takes.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = held = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        met = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
        # A label is a node; its own label is at least as good.
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = materialise(met.join(jump, "low", "left").select("node", "label", F.least("low", F.coalesce("far", "low")).alias("new")), "labels")
        changed = not new.where("new < label").isEmpty()
        release(held)
        held, labels = new, new.select("node", F.col("new").alias("label"))
        if not changed:
            release(both)
            out = labels.withColumnRenamed("label", "component")
            out.scratch = held
            return out
