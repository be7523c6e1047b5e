"""Connected components of an edge table by alternating star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(u, v): label is the smallest node that can be reached.

    Each round points the larger neighbours of every node at its smallest one, then the smaller ones likewise; only
    minima are aggregated, so a node with a third of all edges is summed on the map side. Rounds are written to the
    shared folder. Self links and nulls are ignored; repeated edges count once; no edges give no rows.
    """
    now = written(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        last, now = now, written(small.filter("u <> v").distinct(), "edges")
        dropped(last)
    label = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return label.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
