"""Entity-level F0.5 and its report."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entity_f05(true: Iterable[str], predicted: Iterable[str]) -> float:
    """Of one entity's id sets; two empty sets score 1."""
    t, p = set(true), set(predicted)
    if not t and not p:
        return 1.0
    hit = len(t & p)
    return 1.25 * hit / (0.25 * len(t) + len(p)) if hit else 0.0


def macro_f05(truth: Mapping[str, Iterable[str]], predicted: Mapping[str, Iterable[str]]) -> float:
    return sum(entity_f05(t, predicted.get(s, ())) for s, t in truth.items()) / max(len(truth), 1)


def entity_scores(entities: DataFrame, truth: DataFrame, predicted: DataFrame, n_true: DataFrame | None = None) -> DataFrame:
    """entities: s1 and more; truth, predicted: (s1, eid), repeats count once. Returns entities with n_true, n_pred, tp, f05.
    n_true: (s1, n_true) of all entities with a match; truth then needs to hold the true ones of predicted alone."""
    true, pred = truth.select("s1", "eid").distinct(), predicted.select("s1", "eid").distinct()
    both = true.withColumn("t", F.lit(1)).join(pred.withColumn("p", F.lit(1)), ["s1", "eid"], "full")
    counts = both.groupBy("s1").agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count(F.col("t") + F.col("p")).alias("tp"))
    if n_true is not None:
        counts = counts.drop("n_true").join(n_true.select("s1", "n_true"), "s1", "full")
    out = entities.join(counts, "s1", "left").na.fill(0, ["n_true", "n_pred", "tp"])
    f05 = F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), 1.0).otherwise(F.coalesce(F.try_divide(1.25 * F.col("tp"), 0.25 * F.col("n_true") + F.col("n_pred")), F.lit(0.0)))
    return out.withColumn("f05", f05)


def report(scores: DataFrame, by: str | None = None) -> DataFrame:
    """One row (or one for each value of a column): entities, macro F0.5, pair precision and recall, F0.5 with and without matches."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b)), F.lit(0.0))
    single = F.col("n_true") == 0
    return scores.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.avg("f05").alias("macro_f05"),
        ratio("tp", "n_pred").alias("pair_precision"),
        ratio("tp", "n_true").alias("pair_recall"),
        F.avg(F.when(single, F.col("f05"))).alias("f05_singletons"),
        F.avg(F.when(~single, F.col("f05"))).alias("f05_matched"),
    )
