"""TF-IDF over keys that both sides of a partition have."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions.text import literal_map


def weighted(keys: DataFrame, sizes: DataFrame, weights: Mapping[str, float], *, max_df: float, min_df: int = 2, normalise: bool = True) -> DataFrame:
    """keys: (part, side, rid, ns, key), a row per emission; sizes: (part, n_records). Returns (part, side, rid, ns, key, w).
    With a column copies, a record stands for so many equal ones.

    A key's document frequency counts emissions on both sides; keys of one side alone, or outside min_df..max_df, go. Weight
    is ln(records / frequency), times the namespace's weight and the record's emissions; rows then have length 1. Frequent keys
    go before any join of the sides: what a key can fan out to is bounded by max_df squared.
    """
    keys = keys.filter(F.col("ns").isin(list(weights)))
    copies = F.max("copies") if "copies" in keys.columns else F.lit(1)
    counts = keys.groupBy("part", "side", "rid", "ns", "key").agg(F.count(F.lit(1)).alias("tf"), copies.alias("copies"))
    frequency = counts.groupBy("part", "ns", "key").agg(F.sum(F.col("tf") * F.col("copies")).alias("df"), F.max("side").alias("hi"), F.min("side").alias("lo"))
    frequency = frequency.filter((F.col("hi") != F.col("lo")) & F.col("df").between(min_df, max_df))
    idf = frequency.join(F.broadcast(sizes), "part").select("part", "ns", "key", F.ln(F.col("n_records") / F.col("df")).alias("idf"))
    scale = F.try_element_at(literal_map({k: str(v) for k, v in weights.items()}), F.col("ns")).cast("double")
    out = counts.join(idf, ["part", "ns", "key"]).select("part", "side", "rid", "ns", "key", (F.col("tf") * F.col("idf") * scale).alias("w"))
    return l2(out) if normalise else out


def l2(df: DataFrame) -> DataFrame:
    """Rows of (part, side, rid) to length 1; zero rows stay zero."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("part", "side", "rid")))
    return df.withColumn("w", F.coalesce(F.try_divide("w", norm), F.lit(0.0)))


def pair_stats(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Per pair (part, a, b): cos, cont_ab, cont_ba, nf_a, nf_b of raw weights (side 1 for a, 2 for b); 0 where nothing is shared."""
    totals = weights.groupBy("part", "side", "rid").agg(F.sum("w").alias("sum"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count(F.lit(1)).alias("nf"))
    left = weights.filter("side = 1").select("part", F.col("rid").alias("a"), "ns", "key", F.col("w").alias("wa"))
    right = weights.filter("side = 2").select("part", F.col("rid").alias("b"), "ns", "key", F.col("w").alias("wb"))
    ids = ["part", "a", "b"]
    shared = pairs.select(*ids).join(left, ["part", "a"]).join(right, ["part", "b", "ns", "key"])
    shared = shared.groupBy(*ids).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.sum("wa").alias("sa"), F.sum("wb").alias("sb"))
    one = lambda side, name: totals.filter(F.col("side") == side).select("part", F.col("rid").alias(name), F.col("sum").alias(f"sum_{name}"), F.col("norm").alias(f"norm_{name}"), F.col("nf").alias(f"nf_{name}"))
    out = pairs.select(*ids).join(shared, ids, "left").join(one(1, "a"), ["part", "a"], "left").join(one(2, "b"), ["part", "b"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        *ids,
        zero(F.try_divide("dot", F.col("norm_a") * F.col("norm_b"))).alias("cos"),
        zero(F.try_divide("sa", "sum_a")).alias("cont_ab"),
        zero(F.try_divide("sb", "sum_b")).alias("cont_ba"),
        F.coalesce("nf_a", F.lit(0)).alias("nf_a"),
        F.coalesce("nf_b", F.lit(0)).alias("nf_b"),
    )
