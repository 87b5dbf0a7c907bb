"""Connected components by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of the edges (a, b); component is the least id reachable.

    Each round points every vertex to its least neighbour, follows the pointers
    twice and contracts the edges by them; a component loses at least half its
    vertices in a round, so rounds are logarithmic.  Hub vertices are aggregated
    map-side.  No edges give no rows; loops and repeated edges are harmless.
    """
    spark = edges.sparkSession
    labels = None
    edges = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
        up = both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to"))
        up = stage(up)
        for _ in range(2):
            over = up.select(F.col("id").alias("to"), F.col("to").alias("over"))
            up = up.join(over, "to").select("id", F.col("over").alias("to"))
        up = stage(up)
        if labels is None:
            labels = up.select("id", F.col("to").alias("component"))
        else:
            step = up.select(F.col("id").alias("component"), "to")
            labels = labels.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        ua, ub = up.select(F.col("id").alias("a"), F.col("to").alias("x")), up.select(F.col("id").alias("b"), F.col("to").alias("y"))
        moved = edges.join(ua, "a").join(ub, "b").where("x <> y")
        edges = stage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        labels = stage(labels)
    if labels is None:
        return spark.createDataFrame([], "id long, component long")
    return labels
