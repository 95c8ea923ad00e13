"""Sources and sinks: TSV without quoting, ground truth lists, parquet stages, JSON artefacts."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_COLUMNS = ("entity_id", "business_name", "business_address", "country")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = RECORD_COLUMNS) -> DataFrame:
    """All strings by name from the header, no quoting; a missing value is the empty string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(sep="\t", header=True, quote="", enforceSchema=False).csv(path).na.fill("")


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All strings by name from the header, quoted by RFC 4180, line breaks inside quotes too; a missing value is the empty string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=True, enforceSchema=False).csv(path).na.fill("")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def exploded_truth(df: DataFrame, left: str = "source1_entity_id", right: str = "matched_entity_ids") -> DataFrame:
    """(s1, eid) for each id in the comma list; empty lists give no row."""
    return df.select(F.col(left).alias("s1"), F.explode(F.split(right, ",")).alias("eid")).filter(F.col("eid") != "")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return exploded_truth(read_tsv(spark, path, ("source1_entity_id", "matched_entity_ids")))


def wide_truth(df: DataFrame, left: str = "source1_entity_id", right: str = "matched_entity_ids") -> DataFrame:
    """(s1, eids): the ids of each entity's comma list without empty ones; an empty list stays one."""
    return df.select(F.col(left).alias("s1"), F.filter(F.split(F.coalesce(F.col(right), F.lit("")), ","), lambda x: x != "").alias("eids"))


def id_lists(entities: DataFrame, pairs: DataFrame, order: str, name: str, *, descending: bool = False) -> DataFrame:
    """One row per entity (column s1) with its pairs' ids as an ordered comma list without repeats, '' if none."""
    key = -F.col(order) if descending else F.col(order)
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("o"), "eid"))), lambda x: x["eid"])), ",").alias(name))
    return entities.select("s1").distinct().join(lists, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def write_tsv(df: DataFrame, path: str) -> None:
    """One file a partition, each with the header; no quoting."""
    df.write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="", lineSep="\n").csv(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir of the session)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linkspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/linkspark-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to and read from the shared folder: what several joins read is made once, and no executor's loss takes it away."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], *, force: bool = False, key: str = "") -> DataFrame:
    """The parquet table at path, made and written if it is not there yet. key: what its making depends on; a stage
    made with another key is another one, beside it."""
    path = f"{path}-{key}" if key else path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if force or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def empty_candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "country string, s1 string, eid string, cos_name double, cos_addr double, cos_char double, cheap double, rank int, n_cands int")


def save_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))


def profile(df: DataFrame, by: str) -> DataFrame:
    """Rows, and missing values of each column, by a column."""
    missing = [F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"missing_{c}") for c in df.columns if c != by]
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), *missing)
