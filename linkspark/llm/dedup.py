"""Exact dedup by progressive refinement: normalised length, then prefix hash, then full hash.

Each step groups only what the step before left in groups of two or more. `without_copies`
hashes whole contents only of what the steps before left; `dedup`, whose output has the
digest of every row, takes all of them in the first scan. Groups are pre-aggregated
before any shuffle, so a group of copies of any size moves as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import SPACE, stored, text_of

#: Code points of the normalised text that the second step hashes.
PREFIX = 64


def normal(text: Column) -> Column:
    """The text without its ASCII white space."""
    return F.regexp_replace(text, f"[{SPACE}]+", "")


#: Keys of surviving groups that are broadcast at most (16 bytes each); beyond it the full hash is taken of every row
#: instead, where the texts lie: a join that let only the survivors through would move all texts.
MAX_BROADCAST_KEYS = 1_000_000


def _keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One scan of the texts: id, chars_ (of the original), normal_, length_ and prefix_ (of the normalised text)."""
    text = text_of(text_col)
    df = df.select(F.col(id_col), F.length(text).alias("chars_"), normal(text).alias("normal_"))
    return df.withColumns({"length_": F.length("normal_"), "prefix_": F.xxhash64(F.substring("normal_", 1, PREFIX))})


def groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has id, chars_, length_, prefix_, digest_ for all rows (digest_all) or for those that
    share length and prefix hash with another; groups has digest_, keep_id, group_size for groups of two or more.

    Texts are equal when the same after ASCII white space is deleted; null counts as
    empty, so null, empty and blank texts are one group. The row with the most code
    points in the original stays, then the one with the smallest id. Rows that repeat
    an id and its text count as copies of each other. Other columns are not looked at.
    Texts of any length are hashed whole. An empty table gives empty ones.
    """
    scan = _keys(df, id_col, text_col)
    digest = F.sha2("normal_", 256).alias("digest_")
    names = [id_col, "chars_", "length_", "prefix_"]
    keyed = stored(scan.select(*names, digest) if digest_all else scan.select(*names), "keys")
    pairs = keyed.groupBy("length_", "prefix_").agg(F.count(F.lit(1)).alias("n_"))
    lengths = pairs.groupBy("length_").agg(F.sum("n_").alias("rows_")).filter("rows_ > 1")
    surviving = stored(pairs.filter("n_ > 1").join(lengths, "length_", "left_semi").select("length_", "prefix_"), "surviving")
    if digest_all:
        rows = keyed
        left = rows.join(surviving, ["length_", "prefix_"], "left_semi")
    elif surviving.count() <= MAX_BROADCAST_KEYS:
        rows = left = stored(scan.join(F.broadcast(surviving), ["length_", "prefix_"], "left_semi").select(*names, digest), "digests")
    else:
        rows = left = stored(scan.select(*names, digest).join(surviving, ["length_", "prefix_"], "left_semi"), "digests")
    first = F.min(F.struct((-F.col("chars_")).alias("order_"), F.col(id_col).alias("id_")))
    found = left.groupBy("length_", "prefix_", "digest_").agg(first.alias("first_"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return rows, found.select("digest_", F.col("first_.id_").alias("keep_id"), "group_size")


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, keep_id, group_size long, kept boolean, text_sha256 (of the normalised text).

    Defined as in `groups`. A repeated id with its text is kept in each of its rows; so are rows without
    an id where one of them is the row that stays (keep_id is null for its group).
    """
    rows, found = groups(df, id_col=id_col, text_col=text_col, digest_all=True)
    out = rows.join(found, "digest_", "left")
    keep = F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col(id_col))
    return out.select(id_col, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col(id_col).eqNullSafe(keep).alias("kept"), F.col("digest_").alias("text_sha256"))


def without_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns. Only repeated contents are hashed in full. Rows without an id stay."""
    rows, found = groups(df, id_col=id_col, text_col=text_col)
    gone = rows.join(found, "digest_").filter(~F.col(id_col).eqNullSafe(F.col("keep_id"))).select(F.col(id_col).alias("gone_id_"))
    return df.join(gone, df[id_col] == gone["gone_id_"], "left_anti")


ORACLE = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, arg_min(doc_id, (-chars, doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
