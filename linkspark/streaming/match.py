"""Matching of a stream of new records against a written index of keys.

The index is a static table of weighted keys; each micro-batch joins it (a stream-static
join), sums the shared weights by pair and keeps the best pairs of each new record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.operators.decide import first_of


def index_of(keys: DataFrame, sizes: DataFrame, *, max_df: int) -> DataFrame:
    """keys: (part, rid, key), distinct; sizes: (part, n_records). Returns (part, key, rid, w, idf), in three kinds of rows:
    the keys of records, of at most max_df records each, with weights of length 1 by record; without rid, each key once
    with its idf (0 for those of more records); without key, each part once with the idf of a key that no record has."""
    df = keys.groupBy("part", "key").agg(F.count(F.lit(1)).alias("df"))
    rare = F.ln((F.col("n_records") + 1) / F.col("df"))
    words = df.join(F.broadcast(sizes), "part").select("part", "key", F.when(F.col("df") <= max_df, rare).otherwise(0.0).alias("idf"))
    w = keys.join(words.filter("idf > 0"), ["part", "key"])
    norm = w.groupBy("part", "rid").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    rid = keys.schema["rid"].dataType
    none = [F.lit(None).cast(rid).alias("rid"), F.lit(None).cast("double").alias("w")]
    out = w.join(norm, ["part", "rid"]).select("part", "key", "rid", F.try_divide("idf", "norm").alias("w"), "idf")
    out = out.unionByName(words.select("part", "key", *none, "idf"))
    return out.unionByName(sizes.select("part", F.lit(None).cast(keys.schema["key"].dataType).alias("key"), *none, F.ln(F.col("n_records") + 1.0).alias("idf")))


def matched(batch: DataFrame, index: DataFrame, least: float) -> DataFrame:
    """batch: (part, new, words array). Each new record's best record of the index, if their cosine is at least `least`. A word
    that the index lacks counts as its rarest ones do in the new record's length; one that is too frequent does not count."""
    keys = batch.select("part", "new", F.explode(F.array_distinct("words")).alias("key"))
    words = index.filter("rid is null and key is not null").select("part", "key", "idf")
    parts = index.filter("key is null").select("part", F.col("idf").alias("unseen"))
    known = keys.join(words, ["part", "key"], "left").join(F.broadcast(parts), "part").withColumn("idf", F.coalesce("idf", "unseen")).drop("unseen")
    norm = known.groupBy("part", "new").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    postings = index.filter("rid is not null").select("part", "key", "rid", "w")
    dots = known.join(postings, ["part", "key"]).groupBy("part", "new", "rid").agg(F.sum(F.col("idf") * F.col("w")).alias("dot"))
    scored = dots.join(norm, ["part", "new"]).select("part", "new", "rid", F.round(F.try_divide("dot", "norm"), 9).alias("cos"))
    return first_of(scored.filter(F.col("cos") >= least), ["part", "new"], F.desc("cos"), "rid")


def match_stream(stream: DataFrame, index: DataFrame, path: str, checkpoint: str, *, least: float = 0.8):
    """Starts the query; matches of each micro-batch are written once, under its number."""

    def write(batch: DataFrame, number: int) -> None:
        matched(batch, index, least).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
