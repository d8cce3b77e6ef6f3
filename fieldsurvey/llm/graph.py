"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsurvey.skew import fixed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, comp`` for every node of ``links``: the smallest node that links reach.

    Every node takes the smallest label of its neighbours and then the label of its
    label, until nothing changes; stars and chains end after a few rounds. All sums are
    minima, made before rows are shuffled, so that a node with many links is no hot key.
    """
    both = fixed(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(b, a)))
    labels = fixed(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("comp")))
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("comp").alias("near"))
        met = labels.join(near, labels.node == near.x).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("_up"), F.col("comp").alias("_above"))
        new = fixed(met.join(up, met.comp == up._up).select("node", "old", F.least("comp", "_above").alias("comp")))
        labels = new.select("node", "comp")
        if new.filter("old <> comp").isEmpty():
            return labels
