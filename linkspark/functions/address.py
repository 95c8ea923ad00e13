"""The address normaliser: components as arrays of structs, without Python on the main path."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions import lexicons as L
from linkspark.functions.text import ORDINAL, joined, literal_map, mapped, one_of, strip_accents, transliterated, words_of

ADDRESS_FIELDS = ("a_norm", "a_street", "a_loc", "a_state", "a_nums", "a_house", "a_empty", "a_ids")


def without_zeros(digits: Column) -> Column:
    """Leading zeros go, but for a single 0."""
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def number_runs(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), without_zeros)


def compound_ids(part: Column) -> Column:
    """Identifiers of digits with letters or a slash (D-12, 22/235), in order, compact."""
    found = words_of(F.regexp_replace(F.replace(part, F.lit("#"), F.lit("")), L.ID_PREFIX, " "), r"[\s,;()]+")
    found = F.transform(found, lambda t: F.regexp_replace(t, r"^[.:\-']+|[.:\-']+$", ""))
    found = F.filter(found, lambda t: t.rlike(r"\d") & (t.rlike(r"\p{L}") | F.contains(t, F.lit("/"))) & ~t.rlike(ORDINAL))
    found = F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(t, r"[.\-]", ""), r"(?<!\d)0+(?=\d)", ""))
    return F.filter(found, lambda t: F.length(t) >= 2)


def address_words(part: Column, streets: Column) -> Column:
    """Canonical words: street types and cities mapped, ordinals kept, other numbers and noise words dropped."""
    part = F.regexp_replace(part, "['’`]", "")
    part = F.regexp_replace(part, L.DIGIT_THEN_LETTER, "$1 $2")
    part = F.regexp_replace(part, r"([a-z])(\d)", "$1 $2")
    cities = literal_map(L.CITY_NAMES)

    def word(t: Column) -> Column:
        ordinal = F.replace(F.replace(without_zeros(t), F.lit("eme"), F.lit("e")), F.lit("ere"), F.lit("er"))
        plain = mapped(cities, mapped(streets, t))
        plain = F.when(one_of(plain, L.ADDRESS_NOISE) | (F.length(plain) == 1) | t.rlike(r"\d"), F.lit("")).otherwise(plain)
        return F.when(t.rlike(ORDINAL), ordinal).otherwise(plain)

    return F.filter(F.transform(words_of(part, "[^a-z0-9]+"), word), lambda t: t != "")


def split_numbers(part: Column) -> Column:
    return number_runs(F.regexp_replace(part, "['’`]", ""))


def with_addresses(df: DataFrame, column: str, country: str, table: Mapping[str, str] | None = None) -> DataFrame:
    """df with the eight address fields; null and empty addresses have empty fields and a_empty 1.

    country: a column, of which us, india and france have tables of states; any other has none.
    """
    keep = df.columns
    raw = F.coalesce(F.col(column), F.lit(""))
    key = F.lower(F.trim(F.coalesce(F.col(country), F.lit(""))))
    text = raw
    for native, name in L.NATIVE_STATES.items():
        text = F.replace(text, F.lit(native), F.lit(name))
    text = F.lower(strip_accents(transliterated(text, table)))
    text = F.regexp_replace(text, L.POST_BOX, " ")
    df = df.withColumns({"_ckey": key, "_fr": key == "france"})
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    parts = F.filter(parts, lambda p: ~one_of(p, L.EMPTY_PARTS) & (F.regexp_replace(p, r"[ .\-<>]", "") != ""))
    df = df.withColumn("_parts", parts)
    tables = L.state_tables()
    states = F.lit(None).cast("map<string,string>")
    for name, words in tables.items():
        states = F.when(F.col("_ckey") == name, literal_map(words)).otherwise(states)
    df = df.withColumn("_states", states)
    plain = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "[^a-z ]", " "), r"\s+", " "))
    df = df.withColumn("_named", F.transform("_parts", lambda p: F.coalesce(F.try_element_at(F.col("_states"), plain(p)), F.lit(""))))
    df = df.withColumn("a_state_", F.coalesce(F.try_element_at(F.filter("_named", lambda s: s != ""), F.lit(-1)), F.lit("")))
    # the component that names the state goes, and all that name the same one
    df = df.withColumn("_parts", F.filter("_parts", lambda p, i: (F.get(F.col("_named"), i) == "") | (F.get(F.col("_named"), i) != F.col("a_state_"))))
    streets = F.when(F.col("_fr"), literal_map(L.FRENCH_STREET_WORDS)).otherwise(literal_map(L.STREET_WORDS))
    df = df.withColumn("_streets", streets)
    part = lambda p: F.replace(p, F.lit("-"), F.lit(" "))
    df = df.withColumn(
        "_found",
        F.transform("_parts", lambda p: F.struct(address_words(part(p), F.col("_streets")).alias("words"), split_numbers(part(p)).alias("nums"), compound_ids(p).alias("ids"), (F.col("_fr") & part(p).rlike(L.FRENCH_POSTCODE_CITY)).alias("city"))),
    )
    by_words = lambda x: F.when(F.col("_fr"), F.coalesce(one_of(F.get(x["words"], F.lit(0)), L.FRENCH_STREET_HEADS), F.lit(False))).otherwise(F.coalesce(one_of(F.try_element_at(x["words"], F.lit(-1)), L.STREET_TAILS), F.lit(False)))
    df = df.withColumn("_found", F.transform("_found", lambda x: x.withField("street", ~x["city"] & ((F.size(x["nums"]) > 0) | by_words(x)))))
    all_of = lambda field, keep: F.flatten(F.transform(F.filter("_found", keep), lambda x: x[field]))
    every = lambda x: F.lit(True)
    numbered = F.filter("_found", lambda x: x["street"] & (F.size(x["nums"]) > 0))
    nums = F.array_distinct(all_of("nums", every))
    return df.select(
        *keep,
        joined(F.concat(all_of("words", every), nums)).alias("a_norm"),
        joined(all_of("words", lambda x: x["street"])).alias("a_street"),
        joined(all_of("words", lambda x: ~x["street"])).alias("a_loc"),
        F.col("a_state_").alias("a_state"),
        joined(nums).alias("a_nums"),
        F.coalesce(F.get(F.get(numbered, F.lit(0))["nums"], F.lit(0)), F.lit("")).alias("a_house"),
        (raw == "").cast("tinyint").alias("a_empty"),
        joined(F.array_distinct(all_of("ids", every))).alias("a_ids"),
    )
