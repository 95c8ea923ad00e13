"""Tables whose records are met many times over: results as their SQL has them, and work by distinct record."""

import duckdb
import pandas as pd
import pytest
from linkspark.operators import retrieve
from linkspark.plans import linkage_queries  # noqa: F401  registers its queries
from linkspark.plans import queries as core
from oracle import TABLES, connection, differences

from conftest import TINY

COPIES = 5


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """The smallest tables, customers and suppliers five times with other keys. Keys move by 150, as names come from key % 150."""
    folder = tmp_path_factory.mktemp("copied")
    con = duckdb.connect()
    for t in TABLES:
        key = {"customer": "c_custkey", "supplier": "s_suppkey"}.get(t)
        rows = f"SELECT * REPLACE ({key} + 150 * i AS {key}) FROM '{TINY}/{t}.parquet', range({COPIES}) r(i)" if key else f"SELECT * FROM '{TINY}/{t}.parquet'"
        con.execute(f"COPY ({rows.replace('* REPLACE', '* EXCLUDE (i) REPLACE')}) TO '{folder}/{t}.parquet' (FORMAT PARQUET)")
    return str(folder)


def same(spark, name, sf_dir):
    return differences(core.QUERIES[name](spark, sf_dir).toPandas(), connection(sf_dir).execute(core.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", ["block_three_lists", "block_candidate_recall", "group_competition", "dec_grid", "dec_part_expected_f", "dec_part_thresholds", "dec_reoffered", "metric_report"])
def test_candidates_compare_equal_records_once(spark, copied, monkeypatch, name):
    compared = []

    def counted(df, stage):
        out = real(df, stage)
        if stage == "cosines":
            compared.append(out.count())
        return out

    real = retrieve.stored
    monkeypatch.setattr(retrieve, "stored", counted)
    assert same(spark, name, copied) == ""
    records = linkage_queries.trader_records(spark, copied).toPandas()
    classes = records.groupby(["part", "side", *retrieve.KEY_FIELDS]).size().groupby(["part", "side"]).size().unstack(fill_value=0)
    assert compared and max(compared) <= (classes[1] * classes[2]).sum()


@pytest.mark.parametrize("name", ["feat_sets", "feat_record", "feat_core", "feat_set", "feat_jw", "dec_shapes"])
def test_features_are_made_once_for_equal_records(spark, copied, monkeypatch, name):
    """The rows that features are made of hold several pairs each; what comes of them is every pair."""
    made = []

    def counted(pairs, *found):
        made.append(pairs.count())
        return real(pairs, *found)

    module = core if name in ("feat_set", "feat_jw") else linkage_queries
    real = module.each_pair
    monkeypatch.setattr(module, "each_pair", counted)
    assert same(spark, name, copied) == ""
    assert made and 2 * made[0] <= core.QUERIES[name](spark, copied).count()


@pytest.mark.parametrize("name", ["block_candidate_recall", "dec_grid", "metric_report"])
def test_true_pairs_of_copies_are_not_multiplied(spark, copied, monkeypatch, name):
    """What is scored has true pairs of classes or of the decided pairs, fewer than there are by record."""
    seen = []

    def counted(real, at):
        def run(*args, **named):
            seen.append(args[at].count())
            return real(*args, **named)

        return run

    for module, f, at in ((linkage_queries, "blocking_recall", 1), (linkage_queries.D, "expected_f_grid", 2), (linkage_queries.M, "entity_scores", 1)):
        monkeypatch.setattr(module, f, counted(getattr(module, f), at))
    assert same(spark, name, copied) == ""
    every = linkage_queries.trader_truth(spark, copied).count()
    assert seen and 0 < 2 * seen[0] <= every


def test_names_without_equals_are_scored_by_block(spark, tmp_path, monkeypatch):
    """Where no name is met again, a row of what is scored still holds several pairs; odd names have SQL's scores."""
    odd = [None, "", "Müller é", "muller e", "A" * 70, "ab" * 40, "ß"]
    for t, x, key, n in (("customer", "c", "custkey", 120), ("supplier", "s", "suppkey", 90)):
        names = [*[f"{t.title()}#{k:09d}" for k in range(n)], *odd]
        rows = [(k, None if k == 5 else k % 2, name) for k, name in enumerate(names)]
        pd.DataFrame(rows, columns=[f"{x}_{key}", f"{x}_nationkey", f"{x}_name"]).astype({f"{x}_nationkey": "Int32"}).to_parquet(tmp_path / f"{t}.parquet")
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    made = []

    def counted(pairs, *found):
        made.append(pairs.count())
        return real(pairs, *found)

    real = core.each_pair
    monkeypatch.setattr(core, "each_pair", counted)
    got = core.feat_jw(spark, str(tmp_path)).toPandas()
    assert differences(got, con.execute(core.SQL["feat_jw"]).fetchdf()) == ""
    assert 0 < 2 * made[0] <= len(got)
