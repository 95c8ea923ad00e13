"""Deterministic splits, duplicate ids, and dictionary learning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions.similarity import ratio
from linkspark.functions.text import has_non_latin, romanise, strip_accents

# fixed values: the multiplier and the modulus of the fold formula
FOLD_FACTOR, FOLD_MODULUS = 2654435761, 1000003


def fold_of(number: Column, n_folds: int = 2, salt: int = 7) -> Column:
    """The fold of a whole number, which is reduced first, so that no number overflows."""
    rest = F.pmod(number.cast("bigint"), F.lit(FOLD_MODULUS))
    return F.pmod(F.pmod(rest * F.lit(FOLD_FACTOR) + F.lit(salt), F.lit(FOLD_MODULUS)), F.lit(n_folds)).cast("int")


def hash_share(key: Column, share: float, seed: int = 99) -> Column:
    """A condition that the share of keys meets: by 32 bits of the digest of the seed and the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10_000 < F.lit(round(share * 10_000))


def entity_split(entities: DataFrame, records: DataFrame, truth: DataFrame, share: float = 0.1) -> dict[str, DataFrame]:
    """Entities (s1) by hash into test and train; records (eid) matched to a test entity go with it, all others to train."""
    test = entities.filter(hash_share(F.col("s1"), share))
    with_test = truth.join(test.select("s1"), "s1", "left_semi").select("eid").distinct()
    return {
        "test_entities": test,
        "train_entities": entities.join(test.select("s1"), "s1", "left_anti"),
        "test_records": records.join(with_test, "eid", "left_semi"),
        "train_records": records.join(with_test, "eid", "left_anti"),
        "test_truth": truth.join(test.select("s1"), "s1", "left_semi"),
        "train_truth": truth.join(test.select("s1"), "s1", "left_anti"),
    }


def without_frequent_ids(lists: DataFrame, column: str, most: int = 2) -> DataFrame:
    """Ids that comma lists hold more than `most` times in all go from every list; the order of the others stays."""
    key = [c for c in lists.columns if c != column]
    each = lists.select(*key, F.posexplode(F.split(column, ",")).alias("pos", "eid")).filter(F.col("eid") != "")
    frequent = each.groupBy("eid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("eid")
    kept = each.join(frequent, "eid", "left_anti").groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "eid"))), lambda x: x["eid"]), ",").alias(column))
    return lists.select(*key).join(kept, key, "left").na.fill("", [column]).select(*lists.columns)


def learned_words(pairs: DataFrame, latin: str, native: str, *, min_count: int = 2, min_share: float = 0.5, least: float = 60.0) -> DataFrame:
    """(native_word, word) from names in two scripts: words at equal places where the names have as many; else the Latin word
    whose consonants are most like those of the romanised one. A word's usual partner stays if it is frequent enough."""
    lower = F.regexp_extract_all(F.lower(strip_accents(F.col(latin))), F.lit("([a-z0-9]+)"), F.lit(1))
    other = F.filter(F.transform(F.split(F.trim(F.col(native)), r"\s+"), lambda t: F.regexp_replace(t, r"""^[.,;:()\[\]{}"']+|[.,;:()\[\]{}"']+$""", "")), lambda t: t != "")
    df = pairs.select(lower.alias("l"), other.alias("n")).filter((F.size("l") > 0) & (F.size("n") > 0))
    aligned = df.filter(F.size("l") == F.size("n")).select(F.explode(F.arrays_zip("n", "l")).alias("z")).select(F.col("z.n").alias("native_word"), F.col("z.l").alias("word"))

    @F.pandas_udf("string")
    def nearest(native_words: pd.Series, latin_words: pd.Series) -> pd.Series:
        def bones(w: str) -> str:
            w = "".join(c for c in w.lower() if "a" <= c <= "z")
            return w[:1] + "".join(c for c in w[1:] if c not in "aeiou")

        def pick(w: str, options) -> str | None:
            scores = [(ratio(bones(romanise(w)), bones(x)), -k) for k, x in enumerate(options)]
            best = max(scores, default=(0.0, 0))
            return options[-best[1]] if best[0] >= least else None

        return pd.Series([pick(w, list(o)) for w, o in zip(native_words, latin_words, strict=True)], dtype=object)

    guessed = df.filter(F.size("l") != F.size("n")).select(F.explode("n").alias("native_word"), "l").filter(has_non_latin(F.col("native_word")))
    guessed = guessed.select("native_word", nearest("native_word", "l").alias("word")).filter(F.col("word").isNotNull())
    counts = aligned.filter(has_non_latin(F.col("native_word"))).unionByName(guessed).groupBy("native_word", "word").agg(F.count(F.lit(1)).alias("n"))
    at = Window.partitionBy("native_word")
    counts = counts.withColumns({"all": F.sum("n").over(at), "r": F.row_number().over(at.orderBy(F.desc("n"), "word"))})
    return counts.filter((F.col("r") == 1) & (F.col("n") >= min_count) & (F.col("n") >= min_share * F.col("all"))).select("native_word", "word")
