"""Blocking keys: per record an array of (namespace, key), exploded once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions.lexicons import UNKEYED_STREET_WORDS

#: Weights of the namespaces in the blocks of names and addresses.
NAME_WEIGHTS = {"w": 1.0, "b": 1.0, "c": 1.5}
ADDRESS_WEIGHTS = {"h": 1.5, "hn": 1.5, "hl": 1.2, "x": 1.5, "nb": 1.2, "s": 1.0, "l": 0.6, "n": 0.6, "hv": 1.2, "sl": 0.8}
CHAR_WEIGHTS = {"g": 1.0}


def tokens(column: str, least: int) -> Column:
    """Distinct words of at least so many characters, in order."""
    return F.array_distinct(F.filter(F.split(F.col(column), " "), lambda t: F.length(t) >= least))


def tagged(ns: str, keys: Column) -> Column:
    return F.transform(F.filter(keys, lambda k: k.isNotNull() & (k != "")), lambda k: F.struct(F.lit(ns).alias("ns"), k.alias("key")))


def crossed(first: Column, second: Column) -> Column:
    """#first#second for each of an array; none for an empty or null first."""
    return F.when(F.coalesce(first, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(second, lambda t: F.concat(F.lit("#"), first, F.lit("#"), t)))


def word_keys(df: DataFrame, keep: list[str], *, first_side: Column | None = None) -> DataFrame:
    """(keep..., ns, key), a row for each emission. With first_side (boolean), also the retrieval keys that cross exact
    house numbers of one side with clipped ones of the other, and street with locality words."""
    streets = F.filter(tokens("a_street", 3), lambda t: ~t.isin(list(UNKEYED_STREET_WORDS)))
    parts = {"nt": tokens("n_core", 2), "st": streets, "lt": tokens("a_loc", 3), "nums": tokens("a_nums", 1), "ids": tokens("a_ids", 2)}
    extra = {"first_": first_side} if first_side is not None else {}
    df = df.select(*keep, "n_cmp", "n_full", "a_house", *[v.alias(k) for k, v in (parts | extra).items()])
    nt, st, lt, nums = F.col("nt"), F.col("st"), F.col("lt"), F.col("nums")
    pair = lambda a, b: F.concat(F.least(a, b), F.lit("_"), F.greatest(a, b))
    both = lambda xs, i, j: F.when(F.size(xs) > j, pair(F.get(xs, F.lit(i)), F.get(xs, F.lit(j))))
    glued = F.replace(F.col("n_full"), F.lit(" "), F.lit(""))
    long_enough = lambda c: F.when(F.length(c) >= 4, c)
    found = [
        tagged("w", nt),
        tagged("b", F.array(*[both(nt, i, j) for i in range(4) for j in range(i + 1, 4)])),
        tagged("c", F.array_distinct(F.array(long_enough(F.col("n_cmp")), long_enough(glued)))),
        tagged("x", F.col("ids")),
        tagged("nb", F.array(*[F.concat(F.get(nums, F.lit(i)), F.lit("_"), F.get(nums, F.lit(i + 1))) for i in range(4)])),
        tagged("s", st),
        tagged("l", lt),
        tagged("n", nums),
    ]
    for house in (F.col("a_house"), F.get(nums, F.lit(1))):
        found += [tagged("h", crossed(house, F.slice(st, 1, 3))), tagged("hn", crossed(house, F.slice(nt, 1, 2))), tagged("hl", crossed(house, F.slice(lt, 1, 2)))]
    if first_side is not None:
        house, near = F.col("a_house"), F.slice(st, 1, 3)
        exact = F.when(F.col("first_"), F.lit("E")).otherwise(F.lit("V"))
        clipped = F.when(F.col("first_"), F.lit("V")).otherwise(F.lit("E"))
        mark = lambda tag, keys: F.transform(keys, lambda k: F.concat(tag, k))
        digits = F.when(house.rlike(r"^\d{2,}$"), house)
        variants = F.concat(crossed(F.substring(digits, 2, 1 << 20), near), crossed(F.left(digits, F.length(digits) - 1), near))
        street_place = F.flatten(F.transform(near, lambda s: F.transform(F.slice(lt, 1, 2), lambda t: F.concat(s, F.lit("|"), t))))
        found += [tagged("hv", mark(exact, crossed(house, near))), tagged("hv", mark(clipped, variants)), tagged("sl", street_place)]
    return df.select(*keep, F.explode(F.flatten(F.array(*found))).alias("k")).select(*keep, "k.ns", "k.key")


def char_keys(df: DataFrame, keep: list[str], n: int = 3) -> DataFrame:
    """Distinct runs of n characters of the padded core name; blank ones and cores of a single character give none."""
    padded = F.concat(F.lit(" "), F.col("n_core"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length("p") - (n - 1)), lambda k: F.substring(F.col("p"), k, F.lit(n)))
    df = df.select(*keep, padded.alias("p")).filter(F.length("p") > n + 1)
    return df.select(*keep, F.explode(F.array_distinct(F.filter(grams, lambda g: F.trim(g) != ""))).alias("key")).withColumn("ns", F.lit("g")).select(*keep, "ns", "key")
