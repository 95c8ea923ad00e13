"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The ASCII white space that the contracts name: space and \t \n \v \f \r.
SPACE = r"\x20\x09-\x0D"


#: Rows of a batch that goes to a Python worker, where the session has no number of its own: texts are long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, *clear: Callable[[], object]) -> DataFrame:
    """df.mapInArrow(run, schema), with batches of BATCH_ROWS rows, for workers that outlive a task: at its
    end `clear` empties their tables, and the memory goes back to the system."""
    if df.sparkSession.conf.get(_BATCH) == "10000":  # Spark's own
        df.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))

    def handed_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in clear:
                f()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only this C library has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(handed_back, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder is set if all tasks run in this process (tests);
    on a cluster that is an error, as executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linkspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/linkspark-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to and read from the shared folder, so that what reads them
    again neither computes them again nor depends on one executor's disk."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """The name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(column) if isinstance(column, str) else column, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def share_below(df: DataFrame, key: str, rows: int) -> Column:
    """A condition that about `rows` rows of df meet, chosen by the key's hash (all rows if there are fewer)."""
    n = max(df.count(), 1)
    part = min(1.0, rows / n)
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))
