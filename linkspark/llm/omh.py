"""Near-duplicate detection by Order MinHash.

A text is its sequence of 5-word shingles, each labelled with which of its occurrences
it is. Each of `SKETCHES` hash functions samples the `SAMPLED` labelled shingles with
the least hashes and keeps them in text order; texts whose tuples agree are candidates,
which takes shared content and shared order, and so follows edit similarity. Candidates
are verified by a banded alignment of the two sequences: matches beyond the band that
the wanted similarity leaves cannot be used, and the rest of the work is a longest
increasing chain. Similarity is matches / (shingles of both - matches).

Texts with the same words are one class from the start, so groups of copies are of no
account later. A bucket of up to `SMALL` texts gives all its pairs. In a larger one all
members are compared with its hub at first, which joins most groups of near copies.
What this leaves apart is compared by an exact prefix filter: of two texts at the wanted
similarity, the shingles that come first in one order of all, the rarest first, have
one in common. So texts that share only a frequent passage do not meet, and no link
between members of large buckets is lost.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import mapped, stored
from linkspark.llm.components import PER_TASK, components

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, SAMPLED = 16, 3
SMALL = 8
#: Bits of the slots in which shingles are counted to order them, and of the blocks in which the counts travel.
SLOT_BITS, BLOCK_BITS = 20, 14
#: Texts of large buckets that a task counts at least.
COUNTED = 5_000
WORD = re.compile(r"[^\W_]+")
#: Words whose hashes a worker keeps.
MAX_CACHED = 200_000

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, SKETCHES, dtype=np.int64).astype(np.uint64)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, SHINGLE + 1)]
_words: dict[str, int] = {}


def forget() -> None:
    """Empties the worker's table of words."""
    _words.clear()


def words_of(text: str) -> list[str]:
    """The text's lower-case words."""
    return WORD.findall(text.lower())


def word_hashes(text: str) -> np.ndarray:
    """32-bit hashes of the text's lower-case words."""
    return hashed(words_of(text))


def hashed(found: list[str]) -> np.ndarray:
    if len(_words) > MAX_CACHED:
        _words.clear()
    try:
        return np.array([_words[w] for w in found], np.uint32)
    except KeyError:
        for w in found:
            if w not in _words:
                _words[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.array([_words[w] for w in found], np.uint32)


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of five words; a shorter text is one shingle."""
    w = words.astype(np.uint64)
    if len(w) < SHINGLE:
        w = np.concatenate([w, np.zeros(SHINGLE - len(w), np.uint64)])
    n = len(w) - SHINGLE + 1
    s = np.zeros(n, np.uint64)
    for k, p in enumerate(_POWERS):
        s += (w[k : k + n] + np.uint64(1)) * p
    s ^= s >> np.uint64(32)
    s *= _MIX
    return s ^ (s >> np.uint64(29))


def labelled(s: np.ndarray) -> np.ndarray:
    """Each shingle with the number of its occurrence; all different."""
    order = np.argsort(s, kind="stable")
    run = s[order]
    new = np.concatenate([[True], run[1:] != run[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    out = np.empty_like(s)
    out[order] = run + (np.arange(len(run)) - start).astype(np.uint64) * _MIX
    return out


def sketch(words: np.ndarray) -> np.ndarray:
    """One key per hash function: the sampled shingles in text order."""
    s = shingles(words)
    label = labelled(s)
    n = min(SAMPLED, len(s))
    keys = np.zeros(SKETCHES, np.uint64)
    many = max(1, 1_000_000 // len(s))  # hash functions at once, for texts of any length
    for at in range(0, SKETCHES, many):
        h = label[None, :] ^ _SEEDS[at : at + many, None]
        h *= _MIX
        h ^= h >> np.uint64(30)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        least = np.sort(np.argpartition(h, n - 1, axis=1)[:, :n] if n < len(s) else np.tile(np.arange(n), (len(h), 1)), axis=1)
        for k in range(n):
            keys[at : at + many] = (keys[at : at + many] + s[least[:, k]]) * _POWERS[k]
    return keys


def chain(first: np.ndarray, second: np.ndarray, least: float) -> int:
    """Shingles that a banded alignment of two labelled sequences matches; fewer than are needed may be reported as 0."""
    n, m = len(first), len(second)
    needed = least * (n + m) / (1 + least)
    _, i, j = np.intersect1d(first, second, assume_unique=True, return_indices=True)
    band = n + m - 2 * needed  # insertions and deletions that are left
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < needed - 1e-9:
        return 0
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def similarity(first: np.ndarray, second: np.ndarray, least: float = SIMILARITY) -> float:
    """Of two labelled sequences; 0 if surely below least."""
    matched = chain(first, second, least)
    return matched / (len(first) + len(second) - matched)


def sketches(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc, class_ (of equal words; a text without words: of its characters), n (shingles), keys (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                classes, counts, keys = [], [], []
                for text in part.column(1).to_pylist():
                    found = words_of(text)
                    words = hashed(found)
                    if found:
                        classes.append(xxhash.xxh3_128_digest(" ".join(found).encode("utf-8", "surrogatepass")))
                        counts.append(max(1, len(words) - SHINGLE + 1))
                        keys.append(sketch(words))
                    else:
                        classes.append(xxhash.xxh3_128_digest(b"no words " + text.encode("utf-8", "surrogatepass")))
                        counts.append(0)
                        keys.append(np.zeros(0, np.uint64))
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(classes, pa.binary()), pa.array(counts, pa.int32()), lists], ["doc", "class_", "n", "keys"])

    rows = df.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    return mapped(rows, run, f"doc {rows.schema[0].dataType.simpleString()}, class_ binary, n int, keys array<bigint>", forget)


def sequences(df: DataFrame, docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Of the rows of df whose id is in docs: doc, words (32-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                words = [word_hashes(t) for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*words, np.zeros(0, np.uint32)]).view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc", "words"])

    rows = df.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text_")).join(docs.hint("merge"), "doc", "left_semi")
    return mapped(rows, run, f"doc {rows.schema[0].dataType.simpleString()}, words array<int>", forget)


def _labels(words: pa.ListScalar) -> np.ndarray:
    """The labelled shingles of a row of `sequences`."""
    return labelled(shingles(words.values.to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32)))


def verified(pairs: DataFrame, sequence: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose aligned similarity is at least `least`."""
    # merged, not broadcast, at every size
    one = pairs.hint("merge").join(sequence.select(F.col("doc").alias("a"), F.col("words").alias("words_a")), "a")
    both = one.hint("merge").join(sequence.select(F.col("doc").alias("b"), F.col("words").alias("words_b")), "b").select("a", "b", "words_a", "words_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def sequence_of(batch, k, side):
            doc = batch.column(side)[k].as_py()
            if doc not in known:
                if len(known) >= 64:
                    known.clear()
                known[doc] = _labels(batch.column(side + 2)[k])
            return known[doc]

        for batch in batches:
            alike = [similarity(sequence_of(batch, k, 0), sequence_of(batch, k, 1), least) >= least - 1e-9 for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return mapped(both, run, f"a {kind}, b {kind}")


def counted(sequence: DataFrame, docs: DataFrame) -> np.ndarray:
    """How many labelled shingles of the docs fall in each slot of their hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for words in batch.column(0):
                np.add.at(slots, (_labels(words) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
        blocks = slots.reshape(-1, 1 << BLOCK_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(list(blocks), pa.list_(pa.int64()))], ["block", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[block] = sums.get(block, 0) + counts.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["block", "counts"])

    kind = "block int, counts array<bigint>"
    rows = sequence.join(docs, "doc", "left_semi").select("words").coalesce(1 + docs.count() // COUNTED)
    slots = np.zeros((1 << (SLOT_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.int32)
    for r in mapped(mapped(rows, count, kind).repartition("block"), total, kind).collect():  # a number for each slot
        slots[r.block] = np.minimum(r.counts, 2**31 - 1)
    return slots.reshape(-1)


def unlinked(docs: DataFrame, sequence: DataFrame, label: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of the docs that may be at `least` and are in different components: those with a
    common shingle among the first n - ceil(least * n) + 1 of each, by slot count and hash."""
    docs = stored(docs, "docs")
    slots = docs.sparkSession.sparkContext.broadcast(counted(sequence, docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = slots.value
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                at, keys, left, sizes = [], [], [], []
                for k, words in enumerate(part.column(1)):
                    own = _labels(words)
                    count = held[(own >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                    first = np.lexsort((own, count))[: len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1]
                    some = count[first] > 1  # a slot of one has no other text
                    at.append(np.full(some.sum(), k))
                    keys.append(own[first][some])
                    left.append(len(own) - np.flatnonzero(some))
                    sizes.append(np.full(some.sum(), len(own)))
                if at:
                    docs_at = part.column(0).take(pa.array(np.concatenate(at)))
                    yield pa.RecordBatch.from_arrays([docs_at, pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(left), pa.int32()), pa.array(np.concatenate(sizes), pa.int32())], ["doc", "key", "left", "n"])

    kind = docs.schema["doc"].dataType.simpleString()
    rows = mapped(sequence.join(docs, "doc", "left_semi"), run, f"doc {kind}, key bigint, left int, n int")
    rows = rows.join(label.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "left", "n", F.coalesce("component", "doc").alias("own"))
    rows = stored(rows, "prefixes")
    # keys of one component have no pair
    keys = rows.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo <> hi").select("key")
    rows = stored(rows.join(keys, "key", "left_semi"), "open")
    one, two = (rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("doc", "left", "n", "own")]) for x in "ab")
    needed = F.lit(least / (1 + least)) * (F.col("n_a") + F.col("n_b")) - 1e-9
    # from the first shingle in common on, each text must have as many as are needed
    may = (one["key"] == two["key"]) & (F.col("doc_a") < F.col("doc_b")) & (F.col("own_a") != F.col("own_b")) & (F.least("left_a", "left_b") >= needed)
    return one.hint("merge").join(two, may).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct()


def near_classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Per row: id, class_id (the least id of its class), class_size long.

    Classes are the connected components of links: equal word sequences (lower case,
    letters and digits), or an aligned similarity of `least` or more. Null text counts as
    empty. Texts without words are alike if equal; those with under five words if their
    words are. Rows that repeat an id are in the class of each of their texts' first id.
    An empty table gives an empty one. Other columns are not looked at. Texts of any
    length are compared whole. Of shingles with equal least hashes those that come first
    in numpy's partition are sampled, the same for equal texts. Two texts at similarity 0.8 share a bucket with probability
    1 - (1 - 0.8**3)**16, about 0.99999.
    """
    rows = stored(sketches(df, id_col=id_col, text_col=text_col), "sketches")
    distinct = stored(rows.groupBy("class_").agg(F.min(F.struct("doc", "n", "keys")).alias("first_")).select("class_", "first_.*"), "classes")
    members = distinct.select("doc", "n", F.posexplode("keys").alias("band", "key"))
    sizes = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(members.join(sizes, ["band", "key"]), "members")
    sequence = stored(sequences(df, members.select("doc").distinct(), id_col=id_col, text_col=text_col).dropDuplicates(["doc"]), "sequences")
    fits = (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9) & (F.col("a") != F.col("b"))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    small = members.filter(F.col("size") <= SMALL).groupBy("band", "key").agg(F.sort_array(F.collect_list(F.struct("doc", "n"))).alias("m"))
    pair = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, SMALL), lambda y: F.struct(x["doc"].alias("a"), x["n"].alias("na"), y["doc"].alias("b"), y["n"].alias("nb")))))
    pairs = small.select(F.explode(pair).alias("p")).select("p.*").filter(fits).select(*ordered)

    large = members.filter(F.col("size") > SMALL)
    n_large = large.count()
    at = ["band", "key"]
    tasks = 1 + n_large // PER_TASK
    centre = lambda o: F.min(F.struct(o.alias("o"), F.col("doc").alias("b"), F.col("n").alias("nb")))
    hubs = pairs.limit(0)
    if n_large:
        # the hub of a bucket is in the most and largest buckets
        weight = members.groupBy("doc").agg(F.sum("size").alias("weight"))
        hub = large.join(weight, "doc").groupBy(*at).agg(centre(-F.col("weight")).alias("c")).select(*at, F.col("c.b").alias("hub"), F.col("c.nb").alias("n_hub"))
        large = stored(large.join(hub, at), "large")
        hubs = large.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("hub").alias("b"), F.col("n_hub").alias("nb")).filter(fits).select(*ordered).distinct().coalesce(tasks)
    links = stored(verified(pairs.union(hubs).distinct(), sequence, least), "links")
    label = stored(components(links), "components")
    if n_large:
        more = stored(verified(unlinked(large.select("doc").distinct(), sequence, label, least), sequence, least), "links")
        label = stored(components(links.union(more)), "components")
    names = distinct.select("class_", F.col("doc").alias("node")).join(label, "node", "left").select("class_", F.coalesce("component", "node").alias("class_id"))
    rows = rows.select("class_", "doc").join(names, "class_")
    counts = rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return rows.join(counts, "class_id").select(F.col("doc").alias(id_col), "class_id", "class_size")


def without_near_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of df whose id is the least of its class, with all their columns."""
    gone = near_classes(df, id_col=id_col, text_col=text_col, least=least).filter(~F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias("gone_id_"))
    gone = stored(gone, "gone")
    return df.join(gone, df[id_col] == gone["gone_id_"], "left_anti")
