"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; where its high bits are zero a chunk
may end. Chunks are normalised: below the wanted length more bits must be zero than
above it, between a least and a greatest length. An insertion moves only the
boundaries near it, so the set of chunk digests resists shifts. A fingerprint is that
set, each digest with its chunk's length, and likeness weighs shared chunks by length.

Texts of all lengths are cut by one rule, into short chunks, so that a text of few
bytes has several too and any two fingerprints can be compared.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from linkspark.llm.common import mapped
from linkspark.llm.order import dealt


class Chunking(NamedTuple):
    """Lengths in bytes; strict_bits and loose_bits must be zero before and after the wanted length."""

    least: int = 4
    wanted: int = 12
    greatest: int = 48
    strict_bits: int = 4
    loose_bits: int = 3


#: Bytes that the rolling hash sees, which has as many bits.
WINDOW = 16
GEAR = np.random.default_rng(20).integers(0, 1 << WINDOW, 256, dtype=np.uint64).astype(np.uint16)
#: Low bits of an entry that hold the chunk's length in bytes; the digest has the other bits.
LENGTH_BITS = 16
#: Values of bytes, and factors of places in a chunk, for digests.
_VALUES = np.random.default_rng(21).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_ODD = 0x9E3779B97F4A7C15


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gear values of the last WINDOW bytes, each shifted by its distance (modulo 2**WINDOW)."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        if len(h) > step:
            moved = h.copy()
            moved[step:] += h[:-step] << np.uint16(step)
            h = moved
    return h


def boundaries(data: bytes, rule: Chunking = Chunking()) -> list[int]:
    """The ends of the chunks of data, the last one len(data); empty data has none."""
    n = len(data)
    if not n:
        return []
    h = gear_hashes(np.frombuffer(data, np.uint8))
    # the high bits see the whole window
    loose = np.flatnonzero(h >> np.uint16(WINDOW - rule.loose_bits) == 0) + 1
    strict = (h[loose - 1] >> np.uint16(WINDOW - rule.strict_bits) == 0).tolist()
    loose = loose.tolist()
    least, wanted, greatest = rule.least, rule.wanted, rule.greatest
    ends, start, j, m = [], 0, 0, len(loose)
    while n - start > least:
        low, mid, high = start + least, start + wanted, start + greatest
        while j < m and loose[j] < low:
            j += 1
        while j < m and loose[j] < mid and not strict[j]:
            j += 1
        end = loose[j] if j < m and loose[j] < high else high
        if end >= n:
            break
        ends.append(end)
        start = end
    ends.append(n)
    return ends


@lru_cache
def _factors(n: int) -> np.ndarray:
    """The factor of each place in a chunk."""
    return np.array([pow(_ODD, k + 1, 1 << 64) for k in range(n)], np.uint64)


def fingerprint(data: bytes, rule: Chunking = Chunking()) -> np.ndarray:
    """The sorted distinct entries digest << LENGTH_BITS | length of data's chunks.

    A digest is a mixed sum of a random value of each byte times an odd factor of its place in the chunk.
    """
    ends = np.array(boundaries(data, rule), np.int64)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    factors = _factors(rule.greatest)
    places = np.arange(len(data)) - np.repeat(starts, sizes)
    x = np.add.reduceat(_VALUES[np.frombuffer(data, np.uint8)] * factors[places], starts)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return np.unique(x >> np.uint64(LENGTH_BITS) << np.uint64(LENGTH_BITS) | sizes.astype(np.uint64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The length of the shared chunks over that of the smaller set; two empty sets are alike, an empty one is like no other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    mask = np.uint64((1 << LENGTH_BITS) - 1)
    total = lambda x: float((x & mask).sum())
    return total(np.intersect1d(a, b, assume_unique=True)) / min(total(a), total(b))


def spelled(entries: np.ndarray) -> str:
    return base64.b64encode(entries.astype("<u8").tobytes()).decode()


def parsed(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def fingerprints(df: DataFrame, *, text_col: str = "text", out_col: str = "fingerprint", rule: Chunking = Chunking()) -> DataFrame:
    """df with `out_col`: the fingerprint of the whole text; null counts as empty, whose fingerprint is ''."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: spelled(fingerprint(t.encode("utf-8", "surrogatepass"), rule)))

    return df.withColumn(out_col, run(F.coalesce(F.col(text_col), F.lit(""))))


def edits(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rule: Chunking = Chunking(), rows_per_range: int = 2000) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third (floor) of the code points replaced by the first
    as many of the next row's text, by descending id; after the last comes the first. A
    single row is its own next one. Null text counts as empty. Rows that share an id are
    ordered by the text's hash, null ids come last. Other columns are not looked at.
    Texts of any length are read whole. An empty table gives an empty one. Ids must be
    whole numbers.
    """
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be a whole number")
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    top = rows.agg(F.max(id_col)).first()[0]
    key = F.coalesce(F.bitwise_not(F.col(id_col).cast("long")), F.lit((1 << 63) - 1))  # descending, for the least long too
    # the first of the order, who follows the last: texts of one id
    first = rows.filter(F.col(id_col).eqNullSafe(top)).select("text_").orderBy(F.xxhash64("text_")).first()
    dealt_rows = dealt(rows, key, rows_per_range)
    dealt_rows = dealt_rows.sortWithinPartitions("range_", "extra_", "key_", F.col(id_col).asc_nulls_last(), F.xxhash64("text_"))
    round_again = dealt_rows.sparkSession.sparkContext.broadcast(first[0] if first else None)
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a row whose next one has not come: range, id, text, fingerprint
        out: list[tuple] = []

        def print_of(text):
            return fingerprint(text.encode("utf-8", "surrogatepass"), rule)

        def finish(row, text, own):
            n = len(row[2])
            cut = n // 3
            edited = row[2][: n - cut] + text[:cut]
            raw = edited.encode("utf-8", "surrogatepass")
            changed = fingerprint(raw, rule)
            out.append((row[1], n, hashlib.sha256(raw).hexdigest(), spelled(row[3]), spelled(changed), likeness(row[3], changed), likeness(row[3], own)))

        def batch_of():
            done = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            return done

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        ended = None  # a range whose extra row has been used
        for batch in batches:
            for k in range(batch.num_rows):
                place, extra, doc, text = (batch.column(i)[k].as_py() for i in range(4))
                if extra and ended == place:
                    continue
                own = print_of(text)
                if held is not None:
                    follows = held[0] == place
                    finish(held, text if follows else round_again.value, own if follows else print_of(round_again.value))
                held = None if extra else (place, doc, text, own)
                if extra:
                    ended = place
                if len(out) >= 200:
                    yield batch_of()
        if held is not None:
            finish(held, round_again.value, print_of(round_again.value))
        if out:
            yield batch_of()

    schema = f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return mapped(dealt_rows.select("range_", "extra_", F.col(id_col).cast("long"), "text_"), run, schema)
