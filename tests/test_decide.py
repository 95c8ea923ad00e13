import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from linkspark.functions import similarity as S
from linkspark.operators import decide as D
from linkspark.operators import metrics as M
from pyspark.sql import functions as F


def best(spark):
    return spark.createDataFrame([("a", "x", "S2", 0.9), ("b", "x", "S2", 0.6), ("a", "y", "S3", 0.4)], "s1 string, eid string, src string, p double")


def test_one_owner_then_threshold_or_expected_f(spark):
    owned = D.one_to_one(best(spark))
    assert {(r.s1, r.eid) for r in owned.collect()} == {("a", "x"), ("a", "y")}
    assert [r.eid for r in D.apply_thresholds(owned, {"S2": 0.5, "S3": 0.5}).collect()] == ["x"]
    assert [r.eid for r in D.expected_f(owned).collect()] == ["x"]


def brute(q, k):
    total = 0.0
    for world in itertools.product((0, 1), repeat=len(q)):
        p = 1.0
        for x, y in zip(q, world, strict=True):
            p *= x if y else 1 - x
        hit, true = sum(world[:k]), sum(world)
        total += p * ((1.0 if not true else 0.0) if k == 0 else 1.25 * hit / (0.25 * true + k))
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.01, 0.99), min_size=1, max_size=7))
def test_exact_decision_equals_enumeration(q):
    q = sorted(q, reverse=True)
    k, value = D.exact_k(q, 0.0)
    values = [brute(q, n) for n in range(len(q) + 1)]
    assert value == pytest.approx(max(values), abs=1e-9) and values[k] == pytest.approx(max(values), abs=1e-9)


def test_exact_cases(spark):
    assert D.exact_k([0.6, 0.6], 0.0)[0] == 2 and D.exact_k([0.6, 0.6], 0.0)[1] > 0.62
    assert D.exact_k([0.05], 0.0)[0] == 0
    rows = spark.createDataFrame([("a", "x", 0.6), ("a", "y", 0.6), ("b", "z", 0.05), ("c", "w", 1e-5)], "s1 string, eid string, q double")
    assert {(r.s1, r.eid) for r in D.exact_f(rows).collect()} == {("a", "x"), ("a", "y")}


def test_isotonic_is_monotone(spark):
    rows = spark.createDataFrame([(p, y) for p, y in zip([0.1, 0.2, 0.8, 0.9] * 50, [0, 0, 1, 1] * 50, strict=True)], "p double, y int")
    knots = D.fit_isotonic(rows)
    got = spark.createDataFrame([(x / 20,) for x in range(21)], "p double").select("p", D.calibrated(F.col("p"), knots).alias("q")).orderBy("p").collect()
    q = [r.q for r in got]
    assert q[1] < 0.1 and q[19] > 0.9 and all(a <= b + 1e-12 for a, b in zip(q, q[1:], strict=False))


def test_shapes_and_offsets(spark):
    rows = spark.createDataFrame([("12", "13", "ecole", "ecole", 0.9), ("12", "12", "ecole", "amis", 0.9), ("12", "12", "ecole", "ecole", 0.9)], "ha string, hb string, ca string, cb string, q double")
    bucket = D.shape_bucket(F.col("ha"), F.col("hb"), F.col("ca"), F.col("cb"))
    got = rows.withColumn("b", bucket).withColumn("o", D.with_offsets(F.col("q"), F.col("b"), {"sibling": -2.0})).collect()
    assert [r.b for r in got] == ["sibling", "samehouse_swap", ""] and got[0].o < 0.6 and got[2].o == pytest.approx(0.9)


def test_metric_dict_and_table_agree(spark):
    truth, pred = {"a": ["x", "y"], "b": [], "c": ["z"]}, {"a": ["x", "y"], "b": [], "c": ["z", "w"]}
    assert M.macro_f05(truth, pred) == pytest.approx((1 + 1 + 1.25 / 2.25) / 3)
    frame = lambda d: spark.createDataFrame([(s, e) for s, es in d.items() for e in es], "s1 string, eid string")
    scores = M.entity_scores(spark.createDataFrame([("a",), ("b",), ("c",)], "s1 string"), frame(truth), frame(pred))
    assert M.report(scores).first().macro_f05 == pytest.approx(0.8519, abs=1e-4)


def test_tuning_takes_the_better_threshold(spark):
    rows = spark.createDataFrame([("a", "x", "S2", 0.7), ("b", "y", "S2", 0.3)], "s1 string, eid string, src string, p double")
    truth = spark.createDataFrame([("a", "x")], "s1 string, eid string")
    rule, f = D.tune_thresholds(rows, spark.createDataFrame([("a",), ("b",)], "s1 string"), truth, ["S2"])
    assert 0.3 < rule["S2"] <= 0.7 and f == 1.0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratio_is_the_indel_similarity(a, b):
    wanted = 100.0 if not a + b else 200.0 * lcs(a, b) / (len(a) + len(b))
    assert S.ratio(a, b) == pytest.approx(wanted)
    assert 0 <= S.partial(a, b) <= 100 and 0 <= S.token_set(a, b) <= 100 and S.token_sort(a, b) == S.token_sort(b, a)


def test_known_similarities():
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(96.11, abs=0.01)
    assert S.token_sort("peak holloway", "holloway peak") == 100
    assert S.token_set("holloway peak inc", "holloway peak") == 100
    assert S.partial("abc", "xxabcxx") == 100


# -- rules by part, grids and tuning, against plain versions -------------------------------


def f05(true, pred):
    hit = len(true & pred)
    return 1.0 if not true and not pred else 1.25 * hit / (0.25 * len(true) + len(pred)) if hit else 0.0


def few(seed, n=40):
    import random

    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(12)}", f"e{k}", rng.choice(["S2", "S3"]), round(rng.random(), 3)) for k in range(n)]
    truth = {(s, e) for s, e, _, p in rows if rng.random() < p}
    return rows, truth, [f"s{k}" for k in range(14)]


def plain_macro(rows, truth, entities, kept):
    of = lambda pairs, s: {e for x, e in pairs if x == s}
    return sum(f05(of(truth, s), of(kept, s)) for s in entities) / len(entities)


def test_thresholds_are_tuned_as_by_a_plain_ascent(spark):
    rows, truth, entities = few(1)
    now, value = {"S2": 0.5, "S3": 0.5}, None
    score = lambda thr: plain_macro(rows, truth, entities, {(s, e) for s, e, src, p in rows if p >= thr[src]})
    value = score(now)
    for _ in range(2):
        for src in ("S2", "S3"):
            for t in [round(0.10 + 0.02 * k, 2) for k in range(45)]:
                f = score(now | {src: t})
                if f > value + 1e-7:
                    now, value = now | {src: t}, f
    got = D.tune_thresholds(spark.createDataFrame(rows, "s1 string, eid string, src string, p double"), spark.createDataFrame([(s,) for s in entities], "s1 string"), spark.createDataFrame(sorted(truth), "s1 string, eid string"), ["S2", "S3"])
    assert got[0] == now and got[1] == pytest.approx(value)


def plain_expected(ps, gamma, missed, floor):
    ps = sorted(((min(p**gamma, 0.999999), e) for e, p in ps if p >= floor), key=lambda x: (-x[0], x[1]))
    total, none, best, run = sum(q for q, _ in ps), 1.0, (0.0, 0), 0.0
    for k, (q, _) in enumerate(ps, 1):
        none *= 1 - q
        run += q
        ef = round(1.25 * run / (0.25 * (total + missed) + k), 12)
        if ef > best[0]:
            best = (ef, k)
    return {e for _, e in ps[: best[1]]} if ps and best[0] > none else set()


def test_the_grid_of_expected_f_equals_a_loop(spark):
    rows, truth, entities = few(2)
    frames = (spark.createDataFrame(rows, "s1 string, eid string, src string, p double"), spark.createDataFrame([(s,) for s in entities], "s1 string"), spark.createDataFrame(sorted(truth), "s1 string, eid string"))
    got = {(r.gamma, r.missed, r.floor): r.f05 for r in D.expected_f_grid(*frames).collect()}
    wanted = {}
    for setting in itertools.product(D.GAMMAS, D.MISSES, D.FLOORS):
        kept = {(s, e) for s in entities for e in plain_expected([(e, p) for x, e, _, p in rows if x == s], *setting)}
        wanted[setting] = plain_macro(rows, truth, entities, kept)
    assert got == pytest.approx(wanted) and len(got) == 45
    top = max((round(f, 12), *k) for k, f in wanted.items())
    assert D.tune_expected_f(*frames) == (dict(zip(("gamma", "missed", "floor"), top[1:], strict=True)), pytest.approx(top[0]))


def test_isotonic_equals_a_plain_pooling(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    p = np.round(rng.random(400), 4)
    y = (rng.random(400) < p**2).astype(int)
    got = D.fit_isotonic(spark.createDataFrame(list(zip(p.tolist(), y.tolist(), strict=True)), "p double, y int"), n_knots=20)
    cuts = np.unique(np.quantile(p, np.linspace(0, 1, 21)))[1:-1]
    place = np.searchsorted(cuts, p, side="right")
    n, hits, sums = (np.bincount(place, w) for w in (np.ones(400), y, p))
    # least squares under monotony: the value of a block is max over starts of min over ends of its mean
    value = [max(min(hits[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(n))) for i in range(k + 1)) for k in range(len(n))]
    # equal neighbours stay apart: knots are weighed by their rows
    means = {}
    for x, v in zip(got["x"][1:-1], got["y"][1:-1], strict=True):
        means.setdefault(round(v, 9), []).append(x)
    plain = {}
    for k, v in enumerate(value):
        plain.setdefault(round(min(max(v, 1e-6), 1 - 1e-6), 9), []).append(k)
    assert list(means) == sorted(plain)
    for v, own in plain.items():
        held = np.isin(place, own)
        assert p[held].min() <= min(means[v]) <= max(means[v]) <= p[held].max()
        if len(means[v]) == 1:
            assert means[v][0] == pytest.approx(p[held].mean())
    assert got["x"][0] == 0.0 and got["x"][-1] == 1.0 and got["x"] == sorted(got["x"]) and sums.sum() == pytest.approx(p.sum())


def test_rules_by_part(spark):
    from linkspark.operators import rules as R

    parts = {"us": {"thr": {"S2": 0.4, "S3": 0.96}, "ef": {"gamma": 1.0, "missed": 0.1, "floor": 0.05}, "lam": 0.0, "knots": {"x": [0.0, 1.0], "y": [0.0, 1.0]}}, "fr": {"thr": {"S2": 0.6}, "ef": {"gamma": 2.0, "missed": 0.0, "floor": 0.93}, "lam": 0.4, "knots": {"x": [0.0, 0.5, 1.0], "y": [0.0, 0.9, 1.0]}}}
    free = R.unseen_rule(parts)
    assert free == {"thr": {"S2": pytest.approx(0.65), "S3": 0.99}, "ef": {"gamma": 2.0, "missed": 0.1, "floor": 0.95}}
    rows = [("us", "a", "1", "S2", 0.5), ("us", "a", "2", "S3", 0.95), ("fr", "b", "3", "S2", 0.5), ("fr", "b", "4", "S3", 0.61), ("xx", "c", "5", "S2", 0.64), ("xx", "c", "6", "S2", 0.66), ("xx", "c", "7", "S9", 0.985)]
    best = spark.createDataFrame(rows, "part string, s1 string, eid string, src string, p double")
    assert sorted(r.eid for r in R.by_thresholds(best, parts, free).collect()) == ["1", "4", "6"]
    got = sorted(r.eid for r in R.by_expected_f(best, parts, free).collect())
    of = lambda part: [(e, p) for x, _, e, _, p in rows if x == part]
    assert got == sorted(plain_expected(of("us"), 1.0, 0.1, 0.05) | plain_expected(of("fr"), 2.0, 0.0, 0.93) | plain_expected(of("xx"), 2.0, 0.1, 0.95))
    exact = sorted(r.eid for r in R.by_exact_f(best, parts, {"x": [0.0, 1.0], "y": [0.0, 1.0]}, temperature=1.5).collect())
    move = lambda p: 1 / (1 + ((1 - p) / p) ** (1 / 1.5))
    wanted = set()
    for qs, lam in (([("1", 0.5), ("2", 0.95)], 0.0), ([("3", 0.9), ("4", 0.9 + 0.11 * 0.1 / 0.5)], 0.4), ([("5", move(0.64)), ("6", move(0.66)), ("7", move(0.985))], 0.0)):
        qs.sort(key=lambda x: -x[1])
        wanted |= {e for e, _ in qs[: D.exact_k([q for _, q in qs], lam)[0]]}
    assert exact == sorted(wanted)
