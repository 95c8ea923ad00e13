"""Rows next to each other in a global order, without a global sort in one task.

The order's range is cut at sampled keys. A row is dealt to its range, and the rows at
a range's ends also to the ranges beside it, so that a scan of one sorted range sees
who stands before its first row and after its last.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled keys per range, for even ranges.
PER_RANGE = 20
#: Ranges, and with them tasks, at most. It bounds what comes to the driver (PER_RANGE keys for each), not the
#: rows: a range is sorted by Spark, which spills, and read as a stream.
MAX_RANGES = 20_000


def cuts_of(keys: DataFrame, rows_per_range: int, max_ranges: int = MAX_RANGES) -> list:
    """Keys that cut the column key_ into ranges of about as many rows; none if one range will do. Reads the keys alone."""
    n = keys.count()
    ranges = max(1, min(max_ranges, n // rows_per_range))
    if ranges == 1:
        return []
    part = int(min(1.0, PER_RANGE * ranges / n) * (1 << 30))
    sample = sorted(r[0] for r in keys.filter(F.pmod(F.xxhash64(F.lit("cut"), "key_"), F.lit(1 << 30)) < F.lit(part)).distinct().collect())
    return sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []


def placed(key: Column, cuts: list, marked: dict | None = None) -> Column:
    """The number of the key's range times 4, and the marks (1, 2) of the keys that have some."""
    marked = marked or {}

    @F.pandas_udf("int")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in parts:
            yield found.map(lambda x: 4 * bisect_right(cuts, x) + marked.get(x, 0)).astype("int32")

    return place(key)


def dealt(df: DataFrame, key: Column, rows_per_range: int, *, before: bool = False, max_ranges: int = MAX_RANGES) -> DataFrame:
    """df with key_, range_ and extra_, partitioned by range_ and sorted by (range_, extra_, key_).

    extra_ is 0 for a row of the range, 1 for the first rows of the next range and, with
    before=True, -1 for the last rows of the one before. key: a column of a type that
    Python orders as Spark does (whole numbers or binary), not null. Each range is one
    partition. Equal keys are in one range: let the key end in an id where many rows may
    be equal. An empty table gives an empty one. df must not have columns of these names.
    """
    keys = df.select(key.alias("key_"))
    cuts = cuts_of(keys, rows_per_range, max_ranges)
    df = df.withColumn("key_", key)
    if not cuts:
        return df.withColumns({"range_": F.lit(0), "extra_": F.lit(0)}).coalesce(1).sortWithinPartitions("range_", "extra_", "key_")
    marks = dict.fromkeys(cuts, 1)  # a cut is the first key of its range
    if before:
        for r in keys.select((placed(F.col("key_"), cuts) / 4).cast("int").alias("range_"), "key_").groupBy("range_").agg(F.max("key_").alias("last")).collect():
            marks[r.last] = marks.get(r.last, 0) + 2
    df = df.withColumn("place_", placed(F.col("key_"), cuts, marks)).withColumn("range_", (F.col("place_") / 4).cast("int"))
    deal = lambda step: F.struct((F.col("range_") - step).alias("r"), F.lit(step).alias("e"))
    mark = F.col("place_").bitwiseAND(3)
    places = F.array_compact(F.array(deal(0), F.when(mark.bitwiseAND(1) > 0, deal(1)), F.when((mark >= 2) & (F.col("range_") < len(cuts)), deal(-1))))
    df = df.withColumn("place_", F.explode(places)).withColumns({"range_": F.col("place_.r"), "extra_": F.col("place_.e")}).drop("place_")
    return df.repartitionById(len(cuts) + 1, "range_").sortWithinPartitions("range_", "extra_", "key_")
