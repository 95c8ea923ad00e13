import __spark_entry__
import pytest
from linkspark.plans import linkage_queries  # noqa: F401  registers its queries
from linkspark.plans import queries as core
from oracle import connection, differences

from conftest import TINY

def test_entry_and_names(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"part", "n_entities", "macro_f05", "n_true", "n_pred", "tp"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_core_queries_match_their_sql(spark, name):
    assert differences(core.QUERIES[name](spark, TINY).toPandas(), connection(TINY).execute(core.SQL[name]).fetchdf()) == ""


@pytest.mark.parametrize("name", ["norm_names", "norm_addresses", "feat_strings"])
def test_queries_without_sql_have_rows(spark, name):
    assert core.QUERIES[name](spark, TINY).count() > 0


def test_parquet_scans_are_pruned(spark):
    plan = core.QUERIES["join_semi"](spark, TINY)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,400000.0)" in plan
    assert "struct<o_custkey:bigint,o_totalprice:double>" in plan


@pytest.mark.parametrize("name", ["er_tfidf_topk_f05", "block_tfidf", "block_cosine", "topk_per_entity", "dec_one_to_one", "block_recall", "group_by_record", "feat_idf"])
def test_deep_queries_keep_frequent_keys(name):
    """Their SQL, which they are held against above, is the query's own at the operator's depth."""
    assert core.DEEP_MAX_DF == 5000 and f"BETWEEN 2 AND {core.MAX_DF} AND" in core.SQL[name]
    assert core.SQL[f"{name}_deep"] == core.SQL[name].replace(f"BETWEEN 2 AND {core.MAX_DF} AND", f"BETWEEN 2 AND {core.DEEP_MAX_DF} AND")
