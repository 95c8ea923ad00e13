"""Token ids as Parquet list columns, written for selective reads.

Files hold consecutive ranges of the id column, rows in order. `ids` is dictionary
encoded, so a row group spells out each token once; `doc_id` and `n_tokens` are delta
encoded (Parquet's second writer version without dictionary); row groups and pages
have set sizes, and the writer adds page indexes, with which a reader of some rows or
of the metadata alone skips the pages of the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.llm.bpe import LibraryBpe, encode
from linkspark.llm.common import mapped, new_path
from linkspark.llm.order import cuts_of, placed

ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 64 << 10
#: Documents of a file, about.
ROWS_PER_FILE = 5000


def write(encoded: DataFrame, path: str, *, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Writes (id, n_tokens, ids) as they lie in the partitions; one file a partition."""
    id_col = encoded.columns[0]
    (
        encoded.write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option(f"parquet.enable.dictionary#{id_col}", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("compression", "zstd")
        .parquet(path)
    )


def write_tokens(df: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Encodes whole texts, appends end_id to each, and writes them in ascending order of the id, nulls last.

    Null or empty texts give the end id alone. Rows that share an id are ordered by
    text. Other columns are not looked at. An empty table writes files without rows.
    Files are cut at sampled ids, read by themselves, so texts are read and moved once.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    known = F.col(id_col).isNotNull()
    cuts = cuts_of(df.filter(known).select(F.col(id_col).alias("key_")), rows_per_file)
    place = F.when(known, placed(F.col(id_col), cuts) / 4).otherwise(F.lit(len(cuts) + 1)).cast("int") if cuts else F.when(known, 0).otherwise(1)
    rows = rows.withColumn("range_", place).repartitionById(len(cuts) + 2, "range_").sortWithinPartitions(F.col(id_col).asc_nulls_last(), "text_").select(id_col, "text_")
    write(encode(rows, tokenizer, id_col=id_col, text_col="text_", kind=LibraryBpe, end_id=end_id), path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written, with file_ (its place in the order) and row_ (in the file)."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return spark.read.parquet(path).select("*", name.alias("file_"), F.col("_metadata.row_index").alias("row_"))


def starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (file_, row_, n_tokens and others) with start, the number of ids before the row.

    files: file_ and sum_ (its ids). Running sums are by file; the list of files is what
    passes through one task.
    """
    files = files.select("file_", F.coalesce(F.sum("sum_").over(Window.partitionBy(F.lit(0)).orderBy("file_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    inside = Window.partitionBy("file_").orderBy("row_").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto_", F.sum("n_tokens").over(inside)).join(F.broadcast(files), "file_")
    return rows.withColumn("start", F.col("before_") + F.col("upto_") - F.col("n_tokens")).drop("before_", "upto_")


def file_sums(spark: SparkSession, path: str) -> DataFrame:
    """file_ and sum_, the number of its ids, from the count column alone; a row for each file (at most MAX_RANGES + 2)."""
    return read_tokens(spark, path).groupBy("file_").agg(F.sum("n_tokens").alias("sum_"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Per row as read: the id, file_, row_, n_tokens (ids found) and the crc32 of its ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
            raw = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names)

    rows = read_tokens(spark, path)
    id_col = rows.columns[0]
    names = [id_col, "file_", "row_", "n_tokens", "ids_crc32"]
    return mapped(rows.select(id_col, "file_", "row_", "ids"), run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, file_ int, row_ bigint, n_tokens bigint, ids_crc32 bigint")


def digest(documents: DataFrame, tokenizer: str) -> DataFrame:
    """op8: writes the table's tokens, reads the files back once, and gives start, count and checksum of each document."""
    spark = documents.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(documents, path, tokenizer)
    return starts(checksums(spark, path), file_sums(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
