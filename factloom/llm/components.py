"""Connected components of an edge list by distributed minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """d, comp for every node of edges (a, b): the smallest node reachable. Edges stay distributed; every round is cut.

    Null nodes are left out, loops and repeated edges are harmless, no edges give no rows.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    both = cut(both.distinct())
    labels = cut(both.groupBy(F.col("a").alias("d")).agg(F.min("b").alias("m")).select("d", F.least("d", "m").alias("comp")))
    while True:
        heard = both.join(labels.select(F.col("d").alias("b"), "comp"), "b").groupBy(F.col("a").alias("d")).agg(F.min("comp").alias("m"))
        lower = cut(labels.join(heard, "d").select("d", F.least("comp", "m").alias("comp"), (F.col("m") < F.col("comp")).alias("moved")))
        jump = lower.select(F.col("d").alias("comp"), F.col("comp").alias("next"))
        labels = cut(lower.join(jump, "comp").select("d", F.col("next").alias("comp"), (F.col("moved") | (F.col("next") < F.col("comp"))).alias("moved")))
        if not labels.where("moved").head(1):
            return labels.select("d", "comp")
        labels = labels.select("d", "comp")
