"""Text scalars and the name normaliser, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions import lexicons as L

NON_LATIN = "[^\\u0000-\\u024F\\u1E00-\\u1EFF \\u2000-\\u206F\\u20A0-\\u20CF°’‘“”«»]"
ORDINAL = L.ORDINAL
TOKEN_EDGE = ".,;:()[]{}\"'"


def literal_map(table: Mapping[str, str]) -> Column:
    if not table:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def mapped(table: Column, key: Column) -> Column:
    """The table's value, or the key itself."""
    return F.coalesce(F.try_element_at(table, key), key)


def one_of(x: Column, words: Iterable[str]) -> Column:
    return x.isin(list(words))


def words_of(text: Column, sep: str = r"\s+") -> Column:
    """Non-empty pieces."""
    return F.filter(F.split(text, sep), lambda t: t != "")


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def has_non_latin(text: Column) -> Column:
    return F.coalesce(text.rlike(NON_LATIN), F.lit(False))


def _plain_letters() -> tuple[str, str]:
    """Latin letters whose compatibility form is one ASCII letter with marks, and those letters."""
    found = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00))]
    found = [(a, b) for a, b in found if a != b and len(b) == 1]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def strip_accents(text: Column) -> Column:
    """Latin letters without their marks; combining marks go."""
    return F.translate(F.regexp_replace(text, r"\p{M}+", ""), *_plain_letters())


def romanise(word: str) -> str:
    """A Latin spelling from the letters' Unicode names; consonants of Indic scripts carry an a unless a vowel sign or virama follows."""
    out: list[str] = []
    for c in unicodedata.normalize("NFC", word):
        name = unicodedata.name(c, "")
        last = name.rsplit(" ", 1)[-1].lower()
        if c.isascii():
            out.append(c.lower())
        elif "VOWEL SIGN" in name or "SIGN VIRAMA" in name:
            if out and out[-1].endswith("a") and len(out[-1]) > 1:
                out[-1] = out[-1][:-1]
            if "VOWEL SIGN" in name:
                out.append(last)
        elif "SIGN" in name and last in ("anusvara", "candrabindu", "chandrabindu", "bindi", "tippi"):
            out.append("n")
        elif "DIGIT" in name and c.isdigit():
            out.append(str(unicodedata.digit(c)))
        elif "LETTER" in name:
            out.append(last)
    return "".join(x for x in "".join(out) if x.isascii() and x.isalnum())


def transliterated(text: Column, table: Mapping[str, str] | None = None) -> Column:
    """Per word: Latin ones stay; others by the table, else by the letters' names. Texts in Latin script pass as they are."""
    known = dict(table or {})

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        import re

        other = re.compile("[^\u0000-ɏḀ-ỿ  -⁯₠-⃏]")

        def word(t: str) -> str:
            if not other.search(t):
                return t
            t = t.strip(TOKEN_EDGE)
            return known[t] if t in known else romanise(t)

        return texts.map(lambda t: t if t is None or t.isascii() else " ".join(map(word, t.split())))

    return F.when(has_non_latin(text), run(text)).otherwise(text)


def without_ocr_swaps(token: Column) -> Column:
    """Digits read for letters inside words, and a leading l before a consonant, put right."""
    kept = token.rlike(r"^\d+$") | token.rlike(ORDINAL) | one_of(token, L.LEGAL_FORMS)
    mixed = F.when(token.rlike(r"\d") & token.rlike("[a-z]"), F.translate(token, L.OCR_FROM, L.OCR_TO)).otherwise(token)
    return F.when(kept, token).otherwise(F.regexp_replace(mixed, "^l(?=[bcdfghjkmnpqrstvwxz])", "i"))


def without_repeats(words: Column) -> Column:
    """Of equal neighbours, one."""
    return F.filter(words, lambda x, i: (i == 0) | (x != F.get(words, i - 1)))


def without_legal_suffix(stem: Column) -> Column:
    """Listed suffixes go, the longest first, as long as three letters stay. A round takes off two letters at least, so half the length is rounds enough."""
    ends = "|".join(sorted(L.LEGAL_SUFFIXES, key=len, reverse=True))
    rounds = F.sequence(F.lit(1), F.greatest(F.length(stem).cast("int") / 2, F.lit(1)).cast("int"))
    return F.aggregate(rounds, stem, lambda s, _: F.regexp_replace(s, f"^(.{{3,}}?)(?:{ends})$", "$1"))


def name_tokens(text: Column) -> Column:
    text = F.regexp_replace(text, "[&+]", " and ")
    for form, word in L.DOTTED_FORMS:
        text = F.regexp_replace(text, form, f" {word} ")
    text = F.regexp_replace(F.regexp_replace(text, r"\bm/s\b", " "), r"\bpvt\.\s?ltd\.?", " pvt ltd ")
    text = F.regexp_replace(F.regexp_replace(text, "['’`]", ""), "[^a-z0-9@$]+", " ")
    return F.filter(F.transform(words_of(text), without_ocr_swaps), lambda t: t != "")


NAME_FIELDS = ("n_full", "n_core", "n_alias", "n_legal", "n_cmp", "is_domain", "is_native", "has_alias")


def with_names(df: DataFrame, column: str, table: Mapping[str, str] | None = None) -> DataFrame:
    """df with the eight name fields; null and empty names have empty fields and zero flags."""
    keep = df.columns
    raw = F.coalesce(F.col(column), F.lit(""))
    df = df.withColumn("_native", has_non_latin(raw))
    text = F.lower(F.trim(strip_accents(transliterated(raw, table))))
    text = F.regexp_replace(text, L.ID_TAGS, " ")
    text = F.regexp_replace(F.regexp_replace(text, "^[^a-z0-9]+", ""), L.HONORIFIC_BEFORE_DOMAIN, "")
    df = df.withColumn("_text", text)
    split = L.ALIASED_NAME
    df = df.withColumn("_aliased", F.col("_text").rlike(split))
    df = df.withColumn("_alias", F.when(F.col("_aliased"), F.regexp_extract("_text", split, 1)).otherwise(F.lit("")))
    df = df.withColumn("_text", F.trim(F.when(F.col("_aliased"), F.regexp_extract("_text", split, 2)).otherwise(F.col("_text"))))
    domain = L.DOMAIN_NAME
    df = df.withColumn("_domain", F.col("_text").rlike(domain))
    df = df.withColumn("_stem", F.when(F.col("_domain"), without_ocr_swaps(F.regexp_replace(F.regexp_extract("_text", domain, 1), "[^a-z0-9]", ""))))
    df = df.withColumn("_bare", without_legal_suffix(F.col("_stem")))
    df = df.withColumn("_tokens", name_tokens(F.col("_text")))
    df = df.withColumn("_tokens", without_repeats(F.col("_tokens")))
    forms = literal_map(L.LEGAL_FORMS)
    canon = list(dict.fromkeys(L.LEGAL_FORMS.values()))
    skipped = (*L.HONORIFICS, *L.FILLERS, *L.STOP_WORDS)
    df = df.withColumn("_full", F.transform("_tokens", lambda t: mapped(forms, t)))
    df = df.withColumn("_core", F.filter("_tokens", lambda t: ~one_of(t, L.LEGAL_FORMS) & ~one_of(t, skipped)))
    plain = F.filter("_full", lambda t: ~one_of(t, canon))
    df = df.withColumn("_core", F.when(F.size("_core") > 0, F.col("_core")).when(F.size(plain) > 0, plain).otherwise(F.col("_full")))
    legal = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("_tokens", lambda t: one_of(t, L.LEGAL_FORMS)), lambda t: F.split(mapped(forms, t), " ")))))
    df = df.withColumn("_alias", name_tokens(F.col("_alias")))
    alias = F.filter("_alias", lambda t: ~one_of(t, L.LEGAL_FORMS) & ~one_of(t, (*L.HONORIFICS, *L.FILLERS)))
    is_domain = F.col("_domain")
    flag = lambda c: c.cast("tinyint")
    choose = lambda a, b: F.when(is_domain, a).otherwise(b)
    return df.select(
        *keep,
        choose(F.col("_stem"), joined("_full")).alias("n_full"),
        choose(F.col("_bare"), joined("_core")).alias("n_core"),
        choose(F.lit(""), joined(alias)).alias("n_alias"),
        choose(F.lit(""), joined(legal)).alias("n_legal"),
        choose(F.col("_bare"), F.array_join("_core", "")).alias("n_cmp"),
        flag(is_domain).alias("is_domain"),
        flag(F.col("_native")).alias("is_native"),
        flag(F.col("_aliased") & ~is_domain).alias("has_alias"),
    )
