"""Cosines of word lists without a shuffle of pairs: lists are dealt to blocks of the two sides, each compared inside one task.

A join on words makes a row for each pair and shared word, and its sums by pair are dealt out again. Here a list goes to the
blocks of its side, and what leaves a block is wanted: all pairs, each record's best ones, or its totals.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.sources.tables import stored

#: Words that are broadcast at most; else they are joined.
MOST_WORDS = 300_000
#: Words in lists: of a part's first side, whose blocks grow as the root of their number, and at most; of the second one at most.
STEP, MOST_FIRST, MOST_SECOND = 150_000, 2_000_000, 4_000_000
#: Rows that leave a worker at once, about.
OUT_ROWS = 100_000

_VALUES = {
    "cosines": {"b": None, "cos": "double"},
    "totals": {"n_pairs": "bigint", "sum_cos": "double", "max_cos": "double"},
    "shares": {"b": None, "cos": "double", "cont_ab": "double", "cont_ba": "double", "nf_a": "bigint", "nf_b": "bigint"},
}


def vocabulary(records: DataFrame, max_df: int | None, min_df: int = 2) -> DataFrame:
    """(part, key, id, n1, n2, n_records) of the words of min_df to max_df records (None: or more) that both sides have; n1, n2: how many of
    each. Ids are consecutive, and so short."""
    sizes = records.groupBy("part").agg(F.count(F.lit(1)).alias("n_records"))
    df = records.select("part", "side", F.explode("words").alias("key")).groupBy("part", "key").agg(F.count(F.lit(1)).alias("df"), F.count_if(F.col("side") == 1).alias("n1"))
    df = df.filter((F.col("n1") > 0) & (F.col("n1") < F.col("df")) & (F.col("df") >= min_df) & (F.lit(True) if max_df is None else F.col("df") <= max_df)).join(F.broadcast(sizes), "part")
    found = stored(df.select("part", "key", F.monotonically_increasing_id().alias("id"), "n1", (F.col("df") - F.col("n1")).alias("n2"), "n_records"), "vocabulary")
    task = F.shiftright("id", 33).cast("int")  # such an id is its task's number, then 33 bits of a place in it
    counts = {r.task: r.n for r in found.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [0, *itertools.accumulate(counts.get(k, 0) for k in range(max(counts, default=0) + 1))]
    place = F.get(F.array(*map(F.lit, before)), task) + F.col("id").bitwiseAND((1 << 33) - 1)
    return found.withColumn("id", place.cast("int" if before[-1] < 1 << 31 else "bigint"))


def compared(records: DataFrame, max_df: int | None, want: str = "cosines", *, top: int | None = None, digits: int = 6) -> DataFrame:
    """records: (part, side, rid, words: distinct). Of the pairs of side 1 (a) and 2 (b) of a part that share a word of the vocabulary:

    cosines: (part, a, b, cos) of all, or of the `top` best of each a in each block (more rows than top: rank them again);
    totals: (part, a, n_pairs, sum_cos, max_cos) by block; shares: (part, a, b, cos, cont_ab, cont_ba, nf_a, nf_b), as pair_stats has them, but NaN, as 0 / 0, where a list weighs nothing.
    max_df None: frequent words too. A word weighs ln(records / records with it), which a block works out: a list holds two short numbers a word. cos and shares are rounded to digits."""
    words = vocabulary(records, max_df)
    parts = words.groupBy("part").agg(F.sum("n1").alias("e1"), F.sum("n2").alias("e2"), F.max("n_records").alias("n_records"))
    first = F.greatest(F.ceil(F.sqrt(F.col("e1") / STEP)), F.ceil(F.col("e1") / MOST_FIRST)).cast("int")
    parts = parts.select("part", "n_records", first.alias("n_i"), F.ceil(F.col("e2") / MOST_SECOND).cast("int").alias("n_j"))
    blocks = parts.agg(F.coalesce(F.sum(F.col("n_i") * F.col("n_j")), F.lit(1))).first()[0]
    known = words.select("part", "key", "id", (F.col("n1") + F.col("n2")).cast("int").alias("df"))
    lists = records.select("part", "side", "rid", F.explode("words").alias("key"))
    lists = lists.join(F.broadcast(known) if words.count() <= MOST_WORDS else known, ["part", "key"])
    lists = lists.groupBy("part", "side", "rid").agg(F.collect_list("id").alias("ids"), F.collect_list("df").alias("dfs")).join(F.broadcast(parts), "part")
    own = lambda n: F.array(F.pmod(F.xxhash64("rid"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = F.col("side") == 1
    dealt = lists.withColumn("i", F.explode(F.when(one, own("n_i")).otherwise(every("n_i")))).withColumn("j", F.explode(F.when(one, every("n_j")).otherwise(own("n_j"))))
    dealt = dealt.select("part", "i", "j", "side", "rid", "ids", "dfs", "n_records").repartition(2 * blocks, "part", "i", "j").sortWithinPartitions("part", "i", "j", "side")
    ident = records.schema["rid"].dataType
    fields = [T.StructField("part", records.schema["part"].dataType), T.StructField("a", ident)]
    fields += [T.StructField(n, ident if t is None else T.DoubleType() if t == "double" else T.LongType()) for n, t in _VALUES[want].items()]
    return dealt.mapInArrow(lambda batches: _blocks(batches, want, top, digits), T.StructType(fields))


def _blocks(batches: Iterator[pa.RecordBatch], want: str, top: int | None, digits: int) -> Iterator[pa.RecordBatch]:
    at, held = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        start = 0
        while start < len(keys):
            end = start + 1
            while end < len(keys) and keys[end] == keys[start]:
                end += 1
            if keys[start] != at:
                if held:
                    yield from _block(at[0], held, want, top, digits)
                at, held = keys[start], []
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield from _block(at[0], held, want, top, digits)


class _Side:
    """Lists of one side of a block: ids (in ascending order), of each word its row, number and weight, and of each row sums."""

    def __init__(self, table: pa.Table):
        table = table.take(pa.compute.sort_indices(table.column("rid")))
        self.rid = table.column("rid").combine_chunks()
        lists = table.column("ids").combine_chunks()
        self.n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        self.id = lists.flatten().to_numpy()
        records = table.column("n_records")[0].as_py() if len(self.n) else 1
        self.w = np.log(records / table.column("dfs").combine_chunks().flatten().to_numpy())
        self.sum = np.bincount(self.row, self.w, len(self.n))
        self.length = np.sqrt(np.bincount(self.row, self.w * self.w, len(self.n)))
        self.norm = np.where(self.length > 0, self.length, np.inf)  # weights of a list without length are 0


def _block(part, held: list[pa.RecordBatch], want: str, top: int | None, digits: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    side = table.column("side").to_numpy()
    a, b = (_Side(table.filter(pa.array(side == k))) for k in (1, 2))
    del table
    held.clear()
    if not len(a.n) or not len(b.n):
        return
    order = np.argsort(b.id, kind="stable")
    words, starts = np.unique(b.id[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    rows, weights = b.row[order].astype(np.intp), b.w[order]
    del order, b.id, b.row, b.w
    unit = weights / b.norm[rows] if want != "shares" else weights[:0]
    del weights
    place = np.minimum(np.searchsorted(words, a.id), len(words) - 1)
    met = words[place] == a.id
    free = bool((a.w == 0).any())  # a shared word may weigh nothing
    bounds = np.append(0, np.cumsum(a.n))
    n_b, scale = len(b.n), 10.0**digits
    rounded = lambda x: np.floor(x * scale + 0.5) / scale
    out: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        of = np.repeat([k for k, *_ in out], [len(x[0]) for _, *x in out])
        columns = [np.concatenate(c) for c in zip(*(x for _, *x in out), strict=True)]
        idents = a.rid.take(pa.array(of))
        arrays = [pa.array([part] * len(of)) if not isinstance(part, str) else pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(of), np.int32)), [part]).dictionary_decode(), idents]
        if want != "totals":
            arrays.append(b.rid.take(pa.array(columns[0])))
            columns = columns[1:]
        return pa.RecordBatch.from_arrays([*arrays, *map(pa.array, columns)], ["part", "a", *_VALUES[want]])

    for k in range(len(a.n)):
        own = slice(bounds[k], bounds[k + 1])
        at = place[own][met[own]]
        if not len(at):
            continue
        lo, hi = starts[at], ends[at]
        near = np.concatenate([rows[x:y] for x, y in zip(lo, hi, strict=True)])
        spread = np.repeat(a.w[own][met[own]], hi - lo)
        shared = np.flatnonzero(np.bincount(near, minlength=n_b)) if free else None
        if want == "shares":  # a word weighs the same on both sides
            both = np.bincount(near, spread, n_b)
            found = np.flatnonzero(both) if shared is None else shared
            both, dots = both[found], np.bincount(near, spread * spread, n_b)[found]
            with np.errstate(invalid="ignore"):
                cos = rounded(dots / (a.length[k] * b.length[found]))
                out.append((k, found, cos, rounded(both / a.sum[k]), rounded(both / b.sum[found]), np.full(len(found), a.n[k]), b.n[found]))
            size += len(found)
            if size >= OUT_ROWS:
                yield made()
                out, size = [], 0
            continue
        dots = np.bincount(near, np.concatenate([unit[x:y] for x, y in zip(lo, hi, strict=True)]) * spread, n_b) / a.norm[k]
        found = np.flatnonzero(dots) if shared is None else shared
        cos = rounded(dots[found])
        if want == "totals":
            out.append((k, np.array([len(found)]), np.array([cos.sum()]), np.array([cos.max()])))
        else:
            if top is not None and len(found) > top:
                best = np.flatnonzero(cos >= np.partition(cos, -top)[-top])
                best = best[np.argsort(-cos[best], kind="stable")][:top]  # rows are in the order of ids
                found, cos = found[best], cos[best]
            out.append((k, found, cos))
        size += len(out[-1][1])
        if size >= OUT_ROWS:
            yield made()
            out, size = [], 0
    if out:
        yield made()
