"""Mixing sources to target weights, as a time-varying curriculum.

Training runs over the time 0..1. Each source has a weight schedule, a piecewise
linear function of time, whose integral up to a time is the share of the source's
target that is wanted by then. A source's documents, in an order by hash and repeated
by passes, fill that demand; inverting the cumulative demand gives each copy its
training position, and copies are range-sorted by position.

The order inside a source needs running sums over a source that may hold a third of
all rows: documents are dealt to `BUCKETS` hash buckets, sums are built by bucket
first, and running sums only inside a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.common import free, stored, word_count

#: Hash buckets of a source; the width of a bucket's number in hex digits.
BUCKETS, HEX = 4096, 3


def targets(sized: DataFrame, weights: Sequence[float], total_ratio: float, max_epochs: float) -> DataFrame:
    """Per source (`key_`): weight_, source_size, target. One row per source passes through one task.

    Sources by code point, null last, have the weights in turn. The sum of targets is
    total_ratio times that of sizes as far as the limits allow; a target stops at
    max_epochs times its source's size and the rest is shared by weight again.
    """
    by = sized.groupBy("key_").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy("key_")
    rank = F.row_number().over(order)
    by = by.withColumn("weight_", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("cap_", F.lit(float(max_epochs)) * F.col("source_size"))
    by = by.withColumn("ratio_", F.col("cap_") / F.col("weight_"))
    fill = Window.partitionBy(F.lit(0)).orderBy("ratio_", "key_")
    whole = Window.partitionBy(F.lit(0))
    by = by.withColumn("before_", F.coalesce(F.sum("cap_").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("still_", F.sum("weight_").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("level_", (F.lit(float(total_ratio)) * F.sum("source_size").over(whole) - F.col("before_")) / F.col("still_"))
    by = by.withColumn("level_", F.min(F.when(F.col("ratio_") > F.col("level_"), F.struct("ratio_", "key_", "level_"))).over(whole)["level_"])
    return by.select("key_", "weight_", "source_size", F.coalesce(F.least(F.col("cap_"), F.col("level_") * F.col("weight_")), F.col("cap_")).alias("target"))


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the piecewise linear weight through the knots (time, weight),
    divided by its whole, reaches the share."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    if not areas or sum(areas) <= 0 or min(w for _, w in knots) < 0:
        raise ValueError("a schedule needs two knots, no negative weight and a positive integral")
    wanted = share * F.lit(sum(areas))
    out, below = None, 0.0
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        if area > 0:
            slope = (w1 - w0) / (t1 - t0)
            rest = F.greatest(wanted - F.lit(below), F.lit(0.0))
            # slope/2 x^2 + w0 x = rest, in the form that also holds for slope 0
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
            x = F.lit(t0) + F.least(F.coalesce(F.try_divide(F.lit(2.0) * rest, F.lit(w0) + root), F.lit(0.0)), F.lit(t1 - t0))
            out = F.when(wanted <= F.lit(below + area), x) if out is None else out.when(wanted <= F.lit(below + area), x)
        below += area
    return out.otherwise(F.lit(float(knots[-1][0])))


def plan(
    df: DataFrame,
    *,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    schedules: Sequence[Sequence[tuple[float, float]]] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0))),
    total_ratio: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    whole: bool = False,
) -> DataFrame:
    """Per document: id, size, source_size, target (of its source), taken (words the mix takes) and
    `copies`, an array of (position, words) with one entry for each pass that takes words of it.

    The k-th source has the k-th weight and schedule, in turn. The last document that
    the target reaches gives only the words that are still missing, so that a source's
    taken words are its target to one word; with whole=True it is taken whole if its
    middle is below the target. Documents without words take no part (taken 0, no
    copies); nor do those of a source past its target. Null text has size 0; null is a
    source of its own, the last. Rows with the same id and size take neighbouring
    places; all rows are kept. An empty table gives an empty plan. Other columns are
    not looked at. Runs over the same rows agree.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string")))
    # parquet keeps what is read twice below; texts are read once
    sized = stored(df.select(F.col(id_col), key.alias("key_"), word_count(text_col).alias("size"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("hash_")), "sizes")
    sized = sized.withColumn("bucket_", F.conv(F.substring("hash_", 1, HEX), 16, 10).cast("int"))
    source = targets(sized, weights, total_ratio, max_epochs)
    kinds = max(len(weights), len(schedules))
    source = source.withColumn("kind_", ((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key_")) - 1) % kinds).cast("int"))
    sums = sized.groupBy("key_", "bucket_").agg(F.sum("size").alias("sum_"))
    sums = sums.withColumn("offset_", F.coalesce(F.sum("sum_").over(Window.partitionBy("key_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    facts = sums.join(source, "key_").select("key_", "bucket_", "offset_", "source_size", "target", "kind_")
    inside = Window.partitionBy("key_", "bucket_").orderBy("hash_", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    df = sized.withColumn("start_", F.sum("size").over(inside) - F.col("size")).join(facts, ["key_", "bucket_"])
    df = df.withColumn("start_", F.col("start_") + F.col("offset_"))
    want = F.round("target").cast("long")
    copies = []
    for n in range(int(-(-max_epochs // 1))):
        start = F.col("start_") + F.lit(n) * F.col("source_size")
        if whole:
            words = F.when(start * 2 + F.col("size") <= want * 2, F.col("size")).otherwise(F.lit(0))
        else:
            words = F.greatest(F.lit(0), F.least(F.col("size"), want - start))
        share = F.least(F.try_divide(start.cast("double"), F.col("target")), F.lit(1.0))
        at = F.lit(None).cast("double")
        for k in range(kinds):
            at = F.when(F.col("kind_") == k, inverse_demand(share, schedules[k % len(schedules)])).otherwise(at)
        copies.append(F.struct(F.round(at, 9).alias("position"), words.cast("long").alias("words")))
    df = df.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    return df.select(id_col, "size", "source_size", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"), "copies")


def mix(df: DataFrame, *, id_col: str = "doc_id", whole: bool = True, **options) -> DataFrame:
    """The mixture: df's columns, a row for each copy, range-sorted by training position.

    With whole=False the one document at the end of a source's target also stands
    whole here; `plan` has the words to use of it. Ids name rows: rows that share an id
    all get the plan of one of them, so that their source passes its target; rows
    without an id take no part. Columns of df may have any names.
    """
    names = df.columns
    ident, copies, copy, at = (free(df, x) for x in ("plan_id", "plan_copies", "plan_copy", "plan_at"))
    made = plan(df, id_col=id_col, whole=whole, **options).filter(F.size("copies") > 0)
    made = made.groupBy(F.col(id_col).alias(ident)).agg(F.min("copies").alias(copies))
    out = df.join(made, df[id_col] == made[ident]).select(*[df[f"`{c}`"] for c in names], F.explode(copies).alias(copy))
    out = out.withColumn(at, F.col(f"{copy}.position")).drop(copy)
    return out.repartitionByRange(at, id_col).sortWithinPartitions(at, id_col).drop(at)


def digest(df: DataFrame) -> DataFrame:
    """op1: the plan of all documents, range-sorted by the position of the first copy (none: last)."""
    out = plan(df).select("doc_id", "size", "source_size", "target", "taken", F.when(F.size("copies") > 0, F.col("copies")[0]["position"]).alias("position"))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = """
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
src AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY k),
ranked AS (SELECT k, source_size, (row_number() OVER (ORDER BY k) - 1) % 3 AS kind FROM src),
w AS (SELECT *, CASE kind WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked),
r AS (SELECT *, cap / weight AS ratio FROM w),
f AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
                 - coalesce(sum(cap) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                / sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
l AS (SELECT arg_min(lev, ratio) AS lev FROM f WHERE ratio > lev),
t AS (SELECT k, source_size, kind, coalesce(least(cap, (SELECT lev FROM l) * weight), cap) AS target FROM w),
c AS (SELECT s.*, t.source_size, t.kind, t.target,
             CAST(sum(size) OVER (PARTITION BY s.k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
      FROM sized s JOIN t USING (k)),
p AS (SELECT *, greatest(0, least(size, CAST(round(target) AS BIGINT) - start)) AS w0,
             greatest(0, least(size, CAST(round(target) AS BIGINT) - (start + source_size))) AS w1,
             least(CAST(start AS DOUBLE) / target, 1.0::DOUBLE) AS share FROM c)
SELECT doc_id, size, source_size, target, CAST(w0 + w1 AS BIGINT) AS taken,
       CASE WHEN w0 > 0 THEN round(CASE kind
         WHEN 0 THEN least(2.0::DOUBLE * share / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2.0::DOUBLE * share)), 1.0::DOUBLE)
         WHEN 1 THEN least(2.0::DOUBLE * share / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * share)), 1.0::DOUBLE)
         ELSE least(2.0::DOUBLE * share / (1.0::DOUBLE + sqrt(1.0::DOUBLE)), 1.0::DOUBLE) END, 9) END AS position
FROM p
"""
