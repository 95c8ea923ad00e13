"""URL filters: a Bloom filter cascade for listed keys, and rules by host and path.

The first level of a cascade encodes the listed keys that the corpus has; the second
those other keys of the corpus that the first takes for listed; the third the listed
ones that the second takes for unlisted, and so on until a level errs no more. Over
the corpus's complete universe of keys the answer is exact, by bits alone.

Level one's rate is chosen so that its false positives are about as many as the listed
keys; so all later levels work on sets of that size, whatever the corpus's.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import mapped, stored

#: Keys of a level that are gathered on the driver (16 bytes each); larger levels are added up by Spark, as bits.
LOCAL_KEYS = 100_000


class Level(NamedTuple):
    words: np.ndarray  # bits, 64 a word
    size: int  # bits
    hashes: int

    def has(self, keys: np.ndarray) -> np.ndarray:
        """keys: (n, 2) unsigned hashes."""
        out = np.ones(len(keys), bool)
        for k in range(self.hashes):
            at = (keys[:, 0] + np.uint64(k) * keys[:, 1]) % np.uint64(self.size)
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def level(keys: np.ndarray, rate: float) -> Level:
    size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(-math.log2(rate)))
    words = np.zeros((size + 63) // 64, np.uint64)
    for k in range(hashes):
        at = (keys[:, 0] + np.uint64(k) * keys[:, 1]) % np.uint64(size)
        np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    return Level(words, size, hashes)


def salted(keys: np.ndarray, n: int) -> np.ndarray:
    """Hashes of their own for level n, so that its errors do not depend on the level's before."""
    x = keys + np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29)) | np.array([0, 1], np.uint64)


class Cascade(NamedTuple):
    levels: list[Level]

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        open_ = np.ones(len(keys), bool)
        for n, one in enumerate(self.levels):
            open_ &= one.has(salted(keys, n))
            out[open_] = n % 2 == 0
        return out


def hashes(key: Column) -> Column:
    return F.array(F.xxhash64(key), F.xxhash64(F.lit(1), key))


def _keys(rows) -> np.ndarray:
    return np.array([r[0] for r in rows], np.int64).reshape(-1, 2).view(np.uint64)


def _unsigned(pairs: pa.Array) -> np.ndarray:
    return pairs.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2).view(np.uint64)


def _level_of(keys: DataFrame, size: int, rate: float, n: int) -> Level:
    """Level n from a table of keys' hashes (a column h): tasks emit the words that their keys touch,
    which are joined by bitwise or; so the bits alone come to the driver."""
    bits, count = max(64, math.ceil(-size * math.log(rate) / math.log(2) ** 2)), max(1, round(-math.log2(rate)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = salted(_unsigned(batch.column(0)), n)
            at = np.unique(np.concatenate([(pairs[:, 0] + np.uint64(k) * pairs[:, 1]) % np.uint64(bits) for k in range(count)]))
            if len(at):
                word, begins = np.unique(at >> np.uint64(6), return_index=True)
                ones = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), begins)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(ones.view(np.int64))], ["word", "ones"])

    found = mapped(keys, run, "word bigint, ones bigint").groupBy("word").agg(F.bit_or("ones").alias("ones")).toArrow()
    words = np.zeros((bits + 63) // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("ones").to_numpy().view(np.uint64)
    return Level(words, bits, count)


def build(universe: DataFrame, listing: DataFrame, local_keys: int = LOCAL_KEYS) -> Cascade:
    """universe: a column `key_` of distinct keys, all that will ever be asked for. listing: the listed
    keys in its only column, of any number, repeated or null ones too. What the cascade takes on the
    driver and in a task is its bits: about 1.5 * (2 + log2(keys / listed)) for each listed key of the universe."""
    listing = listing.toDF("key_").filter("key_ is not null").distinct().withColumn("listed_", F.lit(True))
    known = stored(universe.join(listing, "key_", "left").select(hashes(F.col("key_")).alias("h"), F.coalesce("listed_", F.lit(False)).alias("listed_")), "universe")
    counts = {r[0]: r[1] for r in known.groupBy("listed_").count().collect()}
    n_held = counts.get(True, 0)
    if not n_held:
        return Cascade([])
    held, other = known.filter("listed_").select("h"), known.filter("not listed_").select("h")
    levels: list[Level] = []
    rate = min(0.5, max(n_held / sum(counts.values()), 1e-6))
    while n_held > local_keys or not levels:
        levels.append(_level_of(held, n_held, rate, len(levels)))
        rate, last = 0.5, Cascade([*[Level(np.full(1, ~np.uint64(0)), 64, 1)] * (len(levels) - 1), levels[-1]])
        passed = hit(last, len(levels) % 2 == 1)
        held, other = stored(other.filter(passed(F.array("h"))[0]), "held"), held  # keys on the wrong side
        n_held = held.count()
        if len(levels) > 200:
            raise ValueError("equal hashes of a listed and an unlisted key")
    if n_held:
        # the other side may be larger than what is held: of it too only what the level holds wrongly is gathered
        levels.append(_level_of(held, n_held, 0.5, len(levels)))
        last = Cascade([*[Level(np.full(1, ~np.uint64(0)), 64, 1)] * (len(levels) - 1), levels[-1]])
        wrong = _keys(other.filter(hit(last, len(levels) % 2 == 1)(F.array("h"))[0]).collect())
        now, before = wrong, _keys(held.collect())
        while len(now):
            n = len(levels)
            levels.append(level(salted(now, n), 0.5))
            now, before = before[levels[-1].has(salted(before, n))], now
            if n > 200:
                raise ValueError("equal hashes of a listed and an unlisted key")
    return Cascade(levels)


def hit(cascade: Cascade, wanted: bool = True):
    """A function of an array of keys' hashes: for each, whether it is listed (or, with wanted=False, is not)."""

    @F.pandas_udf("array<boolean>")
    def run(rows):
        lengths = [len(x) for x in rows]
        flat = np.array([h for x in rows for h in x], np.int64).reshape(-1, 2).view(np.uint64)
        found = cascade.has(flat) == wanted if len(flat) else np.zeros(0, bool)
        ends = np.cumsum(lengths)
        return pd.Series([found[e - n : e].tolist() for n, e in zip(lengths, ends, strict=True)])

    return run


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there
    up to `?`, `#` or the end. Null, or a url without `://`: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def suffixes(host: Column) -> Column:
    """The host and the domains above it: a.b.c, b.c, c; none for an empty host."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ".")))


#: The rules of the contract: (allow or block, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Registered names that the query lists, under each of the top-level domains of the tables.
LISTED = tuple(f"{name}.example.{top}" for name in ("casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x") for top in ("com", "org", "net"))


def judge(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, wanted: Iterable[str] | DataFrame = LISTED) -> DataFrame:
    """Per row: id, host, path, rule (null: none fits), verdict, listed.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest that fits decides, of equally long ones the first by code point. Else the
    cascade does: block if the host or a domain above it is listed, else allow. Null or
    odd urls have an empty host, which no rule fits and no list holds: allow. Repeated
    rows stay; an empty table gives an empty one. Other columns are not looked at. Urls
    of any length are read whole. wanted: listed hosts, or a table of them in its only
    column for lists of any length.
    """
    rows = df.select(F.col(id_col), F.col(url_col).alias("url_"))
    host, path = host_and_path(F.col("url_"))
    rows = rows.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        top, slash, rest = text.partition("/")
        fits = ((F.col("host") == top) | F.endswith(F.col("host"), F.lit("." + top))) & F.startswith(F.col("path"), F.lit(slash + rest))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    if not isinstance(wanted, DataFrame):
        wanted = df.sparkSession.createDataFrame([(x,) for x in wanted], "key_ string")
    universe = rows.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key_")).distinct()
    cascade = build(universe, wanted)
    is_listed = F.exists(hit(cascade)(F.transform(suffixes(F.col("host")), hashes)), lambda x: x)
    rows = rows.withColumn("listed", is_listed)
    return rows.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


ORACLE = """
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM r),
v AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
    regexp_matches(host, '(^|\\.)(casino-win|free-bets|ads-track|spam-farm|cheap-pills|adult-x)\\.example\\.(com|org|net)$') AS listed FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM v
"""
