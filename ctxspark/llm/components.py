"""Connected components of an undirected graph, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, comp): a node of each node's component, the same for all of it, for all nodes in links(a, b).

    Each round moves every node to the smallest of its neighbours and itself and contracts the graph: links between
    nodes that moved together go. At least every other node goes, so chains of any length take few rounds, and the
    graph shrinks. Hubs are safe: the minimum is pre-aggregated before the shuffle. Rounds are tables in the shared
    folder; at the end their moves are composed."""
    two = links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v")))
    two = materialize(two.where("u <> v").distinct())
    moves = []
    while not two.isEmpty():
        moves.append(materialize(two.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to"))))
        x, y = moves[-1].withColumnRenamed("to", "x"), moves[-1].select(F.col("u").alias("v"), F.col("to").alias("y"))
        two = materialize(two.join(x, "u").join(y, "v").select(F.col("x").alias("u"), F.col("y").alias("v")).where("u <> v").distinct())
    if not moves:
        return two.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out = moves[-1].select(F.col("u").alias("node"), F.col("to").alias("comp"))
    for m in reversed(moves[:-1]):
        later = out.select(F.col("node").alias("to"), F.col("comp").alias("end"))
        out = m.join(later, "to", "left").select(F.col("u").alias("node"), F.coalesce("end", "to").alias("comp"))
    return materialize(out)
