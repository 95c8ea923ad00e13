"""Connected components of a table of edges, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import stored


#: Edges that a task handles at least; few edges are not spread over many tasks.
PER_TASK = 100_000


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """edges (hi, lo), hi > lo. Every node links its larger (or its smaller and itself) neighbours to the least of them and itself."""
    if large:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks)
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").coalesce(tasks)
    least = edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")).coalesce(tasks)
    out = edges.join(least, edges["hi"] == least["u"]).select(F.explode(F.array("lo", "hi")).alias("hi"), F.col("m").alias("lo"))
    return out.filter("hi <> lo").coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node of an edge: node, component (its least node). Edges stay distributed; each round is
    written to the shared folder. Null ends and loops are left out; repeated edges count once; no edges give no
    rows. Nodes may be of any type that Spark orders. Other columns are not looked at."""
    edges = stored(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        tasks = 1 + mark[0] // PER_TASK
        edges = stored(_star(_star(edges, True, tasks), False, tasks), "stars")
    # now each node but a component's least has one edge, to the least
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct().coalesce(1 + (seen or [0])[0] // PER_TASK)
