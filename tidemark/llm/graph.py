"""Connected components over edges of any key type, distributed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def components(edges: DataFrame, into: Scratch) -> DataFrame:
    """(v, label) for every end of edges (a, b): label is the smallest vertex that v reaches.

    Each round takes the least label among the neighbours, then the label of that label, so chains
    halve. Every round is a written table: a lost executor costs nothing and plans stay short. The result is one of
    the tables of `into`.
    """
    scratch = Scratch(edges.sparkSession)
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("next"))
        jump = labels.select(F.col("v").alias("_v"), F.col("label").alias("_l"))
        new = scratch.write(step.join(jump, F.col("next") == F.col("_v")).select("v", "old", F.least("next", "_l").alias("label")), "labels")
        labels = new.select("v", "label")
        if new.where("old <> label").isEmpty():
            out = into.write(labels, "labels")
            scratch.clear()
            return out
        scratch.clear(both, new)
