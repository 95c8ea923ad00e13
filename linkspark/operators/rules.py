"""Decision rules by part (country): each labelled part has its own, unseen parts a stricter default.

Rules are rows, joined by part, so a decision is one plan for any number of parts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.operators import decide as D

#: What an unseen part's thresholds are above the greatest of the labelled ones, and at most.
MARGIN, MOST_THRESHOLD, MOST_FLOOR = 0.05, 0.99, 0.95


def unseen_rule(parts: Mapping[str, Mapping], margin: float = MARGIN) -> dict:
    """The default of parts without labels, from the rules of those with: {"thr": by source, "ef": parameters}."""
    thr = [r["thr"] for r in parts.values()]
    ef = [r["ef"] for r in parts.values()]
    return {
        "thr": {s: min(MOST_THRESHOLD, max(t[s] for t in thr if s in t) + margin) for s in sorted({s for t in thr for s in t})},
        "ef": {"gamma": max(e["gamma"] for e in ef), "missed": max(e["missed"] for e in ef), "floor": min(MOST_FLOOR, max(e["floor"] for e in ef) + margin)},
    }


def by_thresholds(best: DataFrame, parts: Mapping[str, Mapping], unseen: Mapping) -> DataFrame:
    """best (part, s1, eid, src, p): pairs at or above their part's threshold of the source; a source without one has its part's greatest."""
    spark = best.sparkSession
    rows = [(str(part), s, float(t), float(max(r["thr"].values()))) for part, r in parts.items() for s, t in r["thr"].items()]
    table = spark.createDataFrame(rows, "part_ string, src_ string, own_ double, most_ double")
    own = table.select("part_", "src_", "own_")
    most = table.groupBy("part_").agg(F.max("most_").alias("most_"))
    part = F.col("part").cast("string")
    df = best.join(F.broadcast(most), part == F.col("part_"), "left").drop("part_").join(F.broadcast(own), (part == F.col("part_")) & (F.col("src") == F.col("src_")), "left")
    free = D.by_source(unseen["thr"], "src", max(unseen["thr"].values()))
    return df.filter(F.col("p") >= F.coalesce("own_", "most_", free)).select(*best.columns)


def by_expected_f(best: DataFrame, parts: Mapping[str, Mapping], unseen: Mapping) -> DataFrame:
    """best (part, s1, eid, p), decided by each part's parameters of the expected-F rule."""
    spark = best.sparkSession
    names = ("gamma", "missed", "floor")
    table = spark.createDataFrame([(str(part), *(float(r["ef"][n]) for n in names)) for part, r in parts.items()], "part_ string, gamma_ double, missed_ double, floor_ double")
    df = best.join(F.broadcast(table), F.col("part").cast("string") == F.col("part_"), "left")
    df = df.withColumns({f"{n}_": F.coalesce(f"{n}_", F.lit(float(unseen["ef"][n]))) for n in names})
    return D.expected_f(df, gamma=F.col("gamma_"), missed=F.col("missed_"), floor=F.col("floor_")).select(*best.columns)


def by_exact_f(best: DataFrame, parts: Mapping[str, Mapping], pooled: Mapping, *, temperature: float = 1.0, lam: float = 0.0, offsets: Mapping[str, float] | None = None, bucket: str | None = None) -> DataFrame:
    """best (part, s1, eid, p), decided by the exact rule on calibrated probabilities: a labelled part by its own knots and lam,
    others by the pooled knots at a temperature, with lam and, if named, offsets by shape (a column)."""
    spark = best.sparkSession
    rows = [(str(part), [(float(x), float(y)) for x, y in zip(r["knots"]["x"], r["knots"]["y"], strict=True)], float(r["lam"])) for part, r in parts.items()]
    table = spark.createDataFrame(rows, "part_ string, knots_ array<struct<x: double, y: double>>, lam_ double")
    df = best.join(F.broadcast(table), F.col("part").cast("string") == F.col("part_"), "left")
    free = F.col("part_").isNull()
    q = D.calibrated(F.col("p"), F.coalesce("knots_", D.points_of(pooled)))
    q = F.when(free, D.shifted(q, F.lit(0.0), 1 / temperature)).otherwise(q)
    if offsets and bucket:
        q = F.when(free, D.with_offsets(q, F.col(bucket), offsets)).otherwise(q)
    df = df.withColumns({"q": q, "lam_": F.coalesce("lam_", F.lit(float(lam)))})
    return D.exact_f(df, lam=df.select("s1", F.col("lam_").alias("lam")).distinct()).select(*best.columns)
