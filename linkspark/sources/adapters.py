"""The linkage operators' inputs, made from the star and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: part is the language, S1 to S3 by the source's number, the core name is all distinct words of the text."""
    df = table(spark, sf_dir, "documents")
    number = F.regexp_extract("source", r"(\d+)", 1).try_cast("int") % 3
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1)))
    return df.select(
        F.col("lang").alias("part"),
        F.when(number == 0, 1).otherwise(2).alias("side"),
        F.concat(F.lit("S"), (number + 1).cast("string")).alias("src"),
        F.col("doc_id").alias("rid"),
        "text",
        words.alias("words"),
    )


def document_truth(records: DataFrame) -> DataFrame:
    """(part, s1, eid): equal texts, joined by their digest. A group of copies gives its pairs of the two sides, as the truth of
    a many-to-many match must."""
    text = records.select("part", "side", "rid", F.sha2("text", 256).alias("digest"))
    left = text.filter("side = 1").select("part", "digest", F.col("rid").alias("s1"))
    right = text.filter("side = 2").select("part", "digest", F.col("rid").alias("eid"))
    return left.join(right, ["part", "digest"]).select("part", "s1", "eid")


def party_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (side 1) and suppliers (side 2) by nation, with the fields that blocking and pair features read: the name's
    words, its digits as house number, and segment or nation as locality."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.lower("n_name").alias("nation"))

    def side(name: str, prefix: str, n: int) -> DataFrame:
        df = table(spark, sf_dir, name)
        raw = F.lower(F.col(f"{prefix}_name"))
        return df.select(F.lit(n).alias("side"), F.lit(f"S{n}").alias("src"), F.concat(F.lit(f"S{n}-"), F.col(df.columns[0]).cast("string")).alias("rid"), F.col(f"{prefix}_nationkey").alias("nk"), raw.alias("raw"))

    df = side("customer", "c", 1).unionByName(side("supplier", "s", 2)).join(F.broadcast(nation), "nk")
    digits = F.transform(F.regexp_extract_all("raw", F.lit(r"(\d+)"), F.lit(1)), lambda d: F.regexp_replace(d, r"^0+(?=\d)", ""))
    words = F.trim(F.regexp_replace("raw", "[^a-z]+", " "))
    return df.select(
        F.col("nk").alias("part"), "side", "src", "rid", F.col("raw").alias("business_name"),
        words.alias("n_core"), F.regexp_replace("raw", "[^a-z0-9]", "").alias("n_cmp"), F.trim(F.regexp_replace("raw", "[^a-z0-9]+", " ")).alias("n_full"),
        F.col("nation").alias("a_street"), F.lit("").alias("a_loc"), F.coalesce(F.get(digits, F.lit(0)), F.lit("")).alias("a_house"), F.array_join(digits, " ").alias("a_nums"), F.lit("").alias("a_ids"),
    )


def trader_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (side 1) and suppliers (side 2) by nation, each with the name of a part, and an address made of its brand,
    size and key: records with all the fields that keys and pair features read, and with names that are met again."""
    customer = table(spark, sf_dir, "customer").select(F.lit(1).alias("side"), F.lit("S1").alias("src"), F.col("c_nationkey").alias("part"), F.col("c_custkey").alias("k"))
    supplier = table(spark, sf_dir, "supplier").select(F.lit(2).alias("side"), F.when(F.col("s_suppkey") % 2 == 0, "S2").otherwise("S3").alias("src"), F.col("s_nationkey").alias("part"), F.col("s_suppkey").alias("k"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), "p_name", "p_brand", "p_type", "p_size")
    df = customer.unionByName(supplier).withColumn("pk", F.col("k") * 7 % 150).join(part, "pk")
    k, size, number = F.col("k"), F.col("p_size").cast("string"), (F.col("pk") % 40).cast("string")
    glued = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    df = df.select(
        "side", "src", "part", F.concat(F.lit("T"), F.col("side").cast("string"), F.lit("-"), k.cast("string")).alias("rid"),
        F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("n_core"),
        F.concat("p_name", F.lit(" "), F.lower("p_type"), F.when(k % 2 == 0, " ltd").otherwise("")).alias("n_full"),
        F.when(k % 2 == 0, "ltd").otherwise("").alias("n_legal"), F.lit("").alias("n_alias"),
        F.concat(F.split("p_name", " ")[1], F.lit(" rd")).alias("a_street"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("a_loc"),
        F.when(k % 5 == 0, "").otherwise(size).alias("a_house"), F.concat(size, F.lit(" "), number).alias("a_nums"), F.concat(F.lit("d"), (F.col("pk") % 30).cast("string")).alias("a_ids"),
        F.when(F.col("pk") % 3 == 0, "").when(F.col("pk") % 3 == 1, "kerala").otherwise("goa").alias("a_state"),
        (k % 17 == 0).cast("int").alias("a_empty"), (k % 11 == 0).cast("int").alias("is_domain"), F.lit(0).alias("is_native"), (k % 13 == 0).cast("int").alias("has_alias"),
    )
    return df.withColumns({"n_cmp": glued("n_core"), "n_fc": glued("n_full"), "name_lc": F.col("n_full"), "a_norm": F.concat_ws(" ", "a_street", "a_loc", "a_nums")})
