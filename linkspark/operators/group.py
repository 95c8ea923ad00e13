"""Competition features: a pair among the pairs of its entity and of its record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP_FEATURES = (
    "p1", "n_s1_j", "n_addr_hi_j", "p1_rank_s1", "p1_max_s1", "p1_gap_s1", "p1_n50_s1", "p1_n80_s1", "p1_sum_s1", "p1_max_src_s1", "p1_rank_src_s1",
    "p1_rank_j", "p1_max_other_j", "p1_margin_j", "addr_margin_j", "name_margin_j", "sib_cluster_n", "n_conf_ha_hi",
    "n_conf_ha_src", "n_conf_cc_eq", "n_conf_cc_eq_src", "p1_nunc_s1", "p1_rank_nonsib_s1", "support_max", "support_mean",
)


def by_record(pairs: DataFrame) -> DataFrame:
    """Per record (part, b): rivals, and the best and second best p1, cos_addr and cos_name among the entities that found it.
    With a column copies, an entity stands for so many equal ones."""
    # the row with the greatest value is marked by a window without an order, so one sort serves all three columns
    at = Window.partitionBy("part", "b")
    columns = {"p": "p1", "adr": "cos_addr", "nam": "cos_name"}
    own = lambda name: F.struct(columns[name], "a")
    copies = F.col("copies") if "copies" in pairs.columns else F.lit(1)
    ranked = pairs.withColumns({f"top_{name}": F.max(own(name)).over(at) for name in columns})

    def nth(name: str, column: str, n: int):
        found = F.max(column) if n == 1 else F.max(F.when((own(name) != F.col(f"top_{name}")) | (copies > 1), F.col(column)))
        return F.coalesce(found, F.lit(0.0))

    return ranked.groupBy("part", "b").agg(
        F.sum(copies).alias("n_s1_j"),
        nth("p", "p1", 1).alias("first_j"),
        nth("p", "p1", 2).alias("second_j"),
        nth("adr", "cos_addr", 1).alias("a1_j"),
        nth("adr", "cos_addr", 2).alias("a2_j"),
        nth("nam", "cos_name", 1).alias("n1_j"),
        nth("nam", "cos_name", 2).alias("n2_j"),
        F.sum(F.when(F.col("cos_addr") >= 0.6, copies).otherwise(0)).alias("n_addr_hi_j"),
    )


def group_features(pairs: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """pairs: (part, a, b, rank, p1, is_s2, cos_addr, cos_name, hb, sib, has_ha, cc), all of each entity's. support: (part, a, b,
    support_max, support_mean). Every window is by (part, a) and more, so one exchange serves them all. With a column copies, an
    entity stands for so many equal ones, which have the same features."""
    df = pairs.join(by_record(pairs), ["part", "b"])
    at = lambda *more: Window.partitionBy("part", "a", *more)
    order = (F.desc("p1"), "rank", "b")
    count = lambda cond, *more: F.sum(cond.cast("int")).over(at(*more))
    rest = lambda cond, *more: count(cond, *more) - cond.cast("int")
    p1 = F.col("p1")
    sure = p1 > 0.5
    confirms, equal = F.col("has_ha") & sure, (F.col("cc") >= 1.0) & sure
    best = p1 >= F.col("first_j")
    other = F.when(best, F.col("second_j")).otherwise(F.col("first_j"))
    rival = lambda c, one, two: F.col(c) - F.when(F.col(c) >= F.col(one), F.col(two)).otherwise(F.col(one))
    df = df.withColumns(
        {
            "p1_rank_s1": F.row_number().over(at().orderBy(*order)),
            "p1_max_s1": F.max("p1").over(at()),
            "p1_n50_s1": count(sure),
            "p1_n80_s1": count(p1 > 0.8),
            "p1_sum_s1": F.sum("p1").over(at()),
            "p1_max_src_s1": F.max("p1").over(at("is_s2")),
            "p1_rank_src_s1": F.row_number().over(at("is_s2").orderBy(*order)),
            "p1_rank_nonsib_s1": F.row_number().over(at("sib").orderBy(*order)),
            "p1_nunc_s1": count((p1 >= 0.1) & (p1 < 0.9)),
            "sib_cluster_n": F.sum("sib").over(at("hb")) - F.col("sib"),
            "n_conf_ha_hi": rest(confirms),
            "n_conf_ha_src": rest(confirms, "is_s2"),
            "n_conf_cc_eq": rest(equal),
            "n_conf_cc_eq_src": rest(equal, "is_s2"),
            "p1_rank_j": F.when(best, 1).when(p1 >= F.col("second_j"), 2).otherwise(3),
            "p1_max_other_j": other,
            "p1_margin_j": p1 - other,
            "addr_margin_j": rival("cos_addr", "a1_j", "a2_j"),
            "name_margin_j": rival("cos_name", "n1_j", "n2_j"),
        }
    )
    df = df.withColumn("p1_gap_s1", F.col("p1_max_s1") - p1)
    ids = ["part", "a", "b"]
    if support is None:
        df = df.withColumns({"support_max": F.lit(0.0), "support_mean": F.lit(0.0)})
    else:
        df = df.join(support, ids, "left").na.fill(0.0, ["support_max", "support_mean"])
    return df.select(*ids, *GROUP_FEATURES)


def cluster_support(pairs: DataFrame, vectors: dict[str, DataFrame], top: int = 4) -> DataFrame:
    """How like a pair's record is to the entity's other best records, times their p1: its maximum and mean.
    vectors: by block, (part, rid, ns, key, w) of the records, rows of length 1; similarity is the mean of the blocks' cosines."""
    rank = F.row_number().over(Window.partitionBy("part", "a").orderBy(F.desc("p1"), "rank", "b"))
    tops = pairs.withColumn("r_", rank).filter(F.col("r_") <= top).select("part", "a", F.col("b").alias("k"), F.col("p1").alias("pk"))
    both = pairs.select("part", "a", "b").join(tops, ["part", "a"]).filter(F.col("b") != F.col("k"))
    wanted = both.select("part", "b", "k").distinct()
    dots = None
    for w in vectors.values():
        x = wanted.join(w.select("part", F.col("rid").alias("b"), "ns", "key", F.col("w").alias("wb")), ["part", "b"])
        x = x.join(w.select("part", F.col("rid").alias("k"), "ns", "key", F.col("w").alias("wk")), ["part", "k", "ns", "key"]).select("part", "b", "k", (F.col("wb") * F.col("wk") / len(vectors)).alias("d"))
        dots = x if dots is None else dots.union(x)
    similar = dots.groupBy("part", "b", "k").agg(F.sum("d").alias("sim"))
    s = F.coalesce("sim", F.lit(0.0)) * F.col("pk")
    return both.join(similar, ["part", "b", "k"], "left").groupBy("part", "a", "b").agg(F.max(s).alias("support_max"), F.avg(s).alias("support_mean"))
