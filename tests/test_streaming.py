import math

import pytest
from linkspark.streaming.match import index_of, match_stream, matched
from pyspark.sql import functions as F


def test_new_records_find_their_record(spark, tmp_path):
    words = lambda k: [f"w{k}", f"v{k}", "common"]
    old = spark.createDataFrame([("p", k, words(k)) for k in range(20)], "part string, rid int, words array<string>")
    index = index_of(old.select("part", "rid", F.explode("words").alias("key")), old.groupBy("part").agg(F.count(F.lit(1)).alias("n_records")), max_df=10)
    schema = "part string, new int, words array<string>"
    spark.createDataFrame([("p", 100 + k, [*words(k), "unseen"]) for k in range(3)] + [("p", 200, ["nothing"])], schema).write.parquet(f"file://{tmp_path}/in")
    q = match_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), index, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    got = {(r.new, r.rid) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {(100, 0), (101, 1), (102, 2)}


def test_words_that_the_index_lacks_lower_the_score(spark):
    old = spark.createDataFrame([("p", k, [f"w{k}", f"v{k}", "common"]) for k in range(20)], "part string, rid int, words array<string>")
    index = index_of(old.select("part", "rid", F.explode("words").alias("key")), old.groupBy("part").agg(F.count(F.lit(1)).alias("n_records")), max_df=10)
    new = spark.createDataFrame([("p", 1, ["w3", "common"]), ("p", 2, ["w3", "v3", "a", "b"]), ("p", 3, ["common", "x"]), ("q", 4, ["w3"])], "part string, new int, words array<string>")
    got = {r.new: (r.rid, r.cos) for r in matched(new, index, 0.1).collect()}
    # w3 and v3 weigh alike, as much as a word that no record has
    assert got == {1: (3, pytest.approx(math.sqrt(1 / 2))), 2: (3, pytest.approx(2 / (math.sqrt(2) * 2)))}
