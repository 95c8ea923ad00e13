"""Context of a pair: how often its names and addresses occur on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT_FEATURES = ("s1_name_dup", "s1_name_in_s23", "s1_addr_dup", "b_name_dup", "b_name_in_s1", "b_addr_dup")


def with_context(records: DataFrame) -> DataFrame:
    """Per record (part, side, rid): name_dup, name_other, addr_dup. An empty address counts 0; an empty name is a name."""
    names = records.groupBy("part", "n_cmp").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2"))
    addresses = records.filter(F.col("a_norm") != "").groupBy("part", "side", "a_norm").agg(F.count(F.lit(1)).alias("n"))
    df = records.select("part", "side", "rid", "n_cmp", "a_norm").join(names, ["part", "n_cmp"], "left").join(addresses, ["part", "side", "a_norm"], "left")
    own = F.when(F.col("side") == 1, F.col("n1")).otherwise(F.col("n2"))
    other = F.when(F.col("side") == 1, F.col("n2")).otherwise(F.col("n1"))
    return df.select("part", "side", "rid", own.alias("name_dup"), other.alias("name_other"), F.coalesce("n", F.lit(0)).alias("addr_dup"))


def context_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pairs (part, a, b) with CONTEXT_FEATURES."""
    seen = with_context(records)
    left = seen.filter("side = 1").select("part", F.col("rid").alias("a"), F.col("name_dup").alias("s1_name_dup"), F.col("name_other").alias("s1_name_in_s23"), F.col("addr_dup").alias("s1_addr_dup"))
    right = seen.filter("side = 2").select("part", F.col("rid").alias("b"), F.col("name_dup").alias("b_name_dup"), F.col("name_other").alias("b_name_in_s1"), F.col("addr_dup").alias("b_addr_dup"))
    return pairs.join(left, ["part", "a"]).join(right, ["part", "b"])
