"""Word lists compared by block, against a plain loop; no pair goes through a shuffle."""

import math
import random

import duckdb
import pandas as pd
import pytest
from linkspark.operators import lists
from linkspark.plans import queries as core
from oracle import differences

from conftest import TINY


def plain(rows, max_df):
    df, sides, n = {}, {}, {}
    for part, side, _, words in rows:
        n[part] = n.get(part, 0) + 1
        for w in words:
            df[part, w] = df.get((part, w), 0) + 1
            sides.setdefault((part, w), set()).add(side)
    kept = {k: math.log(n[k[0]] / v) for k, v in df.items() if 2 <= v <= max_df and len(sides[k]) == 2}
    own = {(p, s, r): {w: kept[p, w] for w in words if (p, w) in kept} for p, s, r, words in rows}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in own.items()}
    out = {}
    for (p, s, a), x in own.items():
        for (q, t, b), y in own.items():
            if (s, t) == (1, 2) and p == q and (both := x.keys() & y.keys()):
                length = norm[p, 1, a] * norm[p, 2, b]
                out[p, a, b] = sum(x[w] * y[w] for w in both) / length if length else 0.0
    return out


@pytest.mark.parametrize("small_blocks", [False, True])
def test_blocks_against_a_loop(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(lists, "STEP", 20)
        monkeypatch.setattr(lists, "MOST_SECOND", 60)
    rng = random.Random(5)
    rows = [(p, 1 + rng.randrange(2), k + 1000 * (p == "y"), [*{f"w{int(rng.expovariate(0.1))}" for _ in range(12)}, *(["all"] if p == "x" else [])]) for p in "xy" for k in range(60)]
    records = spark.createDataFrame(rows, "part string, side int, rid long, words array<string>")
    want = plain(rows, 100)
    got = {(r.part, r.a, r.b): r.cos for r in lists.compared(records, 100).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    best = {(r.part, r.a, r.b) for r in lists.compared(records, 100, top=3).collect()}
    for p, a in {k[:2] for k in want}:
        first = sorted((k for k in got if k[:2] == (p, a)), key=lambda k: (-got[k], k[2]))[:3]
        assert set(first) <= best
    assert sum(r.n_pairs for r in lists.compared(records, 100, "totals").collect()) == len(want)


@pytest.mark.parametrize("name", ["block_cosine_deep", "dec_one_to_one_deep", "feat_idf", "feat_idf_deep"])
def test_no_pair_is_dealt_out(spark, name):
    plan = core.QUERIES[name](spark, TINY)._jdf.queryExecution().toString()
    assert "mapInArrow" in plan.replace("MapInArrow", "mapInArrow") and "wa" not in plan


def test_words_have_short_consecutive_ids(spark):
    """What is dealt out is two short numbers a word, for any number of tasks that made the vocabulary."""
    rows = [("x", 1 + k % 2, k, [f"w{(k + j) % 90}" for j in range(30)]) for k in range(200)]
    words = lists.vocabulary(spark.createDataFrame(rows, "part string, side int, rid long, words array<string>").repartition(7), 200)
    assert words.schema["id"].dataType.simpleString() == "int"
    assert sorted(r.id for r in words.collect()) == list(range(90))


def test_pairs_are_compared_once_for_an_isotonic_map(spark):
    assert "mapinarrow" not in core.QUERIES["dec_isotonic_deep"](spark, TINY)._jdf.queryExecution().toString().lower()


def test_shares_keep_words_of_any_number_of_records(spark, tmp_path):
    """Pairs that only a word of 90 of 100 records links are there, weighed by it; a part whose words are in all its records has shares of 0 / 0."""
    rows = [("en", f"src{k % 3}", k, f"{'common' if k % 10 else 'scarce'} own{chr(97 + k % 26)}") for k in range(100)]
    rows += [("fr", f"src{k}", 200 + k, "toujours pareil") for k in range(2)]
    pd.DataFrame(rows, columns=["lang", "source", "doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = core.feat_idf(spark, str(tmp_path)).toPandas()
    assert differences(got, con.execute(core.SQL["feat_idf"]).fetchdf()) == ""
    common = {r[2]: r[1] for r in rows if r[3].startswith("common")}
    linked = {(a, b) for a, x in common.items() for b, y in common.items() if x == "src0" != y}
    assert linked <= set(zip(got.a, got.b, strict=True))
    assert got[got.part == "fr"].cos.isna().all() and (got.part == "fr").sum() == 1
    assert "BETWEEN" not in core.SQL["feat_idf"]
