"""Decisions: one owner a record, thresholds, expected F0.5, calibration, offsets by shape."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions.lexicons import SIBLING_OFFSETS
from linkspark.functions.similarity import ratio
from linkspark.operators.metrics import entity_scores

TINY, NEAR_ONE = 1e-6, 1 - 1e-6


def first_of(df: DataFrame, by: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each group by a total order."""
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("r_ = 1").drop("r_")


def one_to_one(pairs: DataFrame, prob: str = "p") -> DataFrame:
    """Each record (eid) keeps its best entity; equal ones: the least s1."""
    return first_of(pairs, ["eid"], F.desc(prob), "s1")


def by_source(values: Mapping[str, float], source: str, default: float) -> Column:
    out = F.lit(float(default))
    for name, v in values.items():
        out = F.when(F.col(source) == name, F.lit(float(v))).otherwise(out)
    return out


def apply_thresholds(best: DataFrame, thresholds: Mapping[str, float], default: float = 0.5, *, prob: str = "p", source: str = "src") -> DataFrame:
    return best.filter(F.col(prob) >= by_source(thresholds, source, default))


def expected_f(best: DataFrame, *, floor: float | Column = 0.05, missed: float | Column = 0.0, gamma: float | Column = 1.0, prob: str = "p", keys: Sequence[str] = ("s1",)) -> DataFrame:
    """The k most probable pairs of each entity with the greatest expected F0.5 in its ratio form, if that beats the chance of no match."""
    at = Window.partitionBy(*keys)
    order = at.orderBy(F.desc("q_"), "eid")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.greatest(F.pow(F.col(prob), F.lit(gamma) if not isinstance(gamma, Column) else gamma), F.lit(0.0)), F.lit(0.999999))
    df = best.filter(F.col(prob) >= floor).withColumn("q_", q)
    df = df.withColumns({"sum_": F.sum("q_").over(upto), "k_": F.row_number().over(order), "all_": F.sum("q_").over(at), "none_": F.exp(F.sum(F.ln(1 - F.col("q_"))).over(at))})
    df = df.withColumn("ef_", F.round(1.25 * F.col("sum_") / (0.25 * (F.col("all_") + missed) + F.col("k_")), 12))
    df = df.withColumn("top_", F.max("ef_").over(at))
    df = df.withColumn("stop_", F.min(F.when(F.col("ef_") == F.col("top_"), F.col("k_"))).over(at))
    return df.filter((F.col("top_") > F.col("none_")) & (F.col("k_") <= F.col("stop_"))).select(*best.columns)


def best_of_grid(best: DataFrame, entities: DataFrame, truth: DataFrame, grid: Sequence[tuple], select: Callable[[DataFrame, tuple], DataFrame]) -> tuple[tuple, float]:
    """The parameters with the greatest macro F0.5; of equal ones the greatest. One job: each entity is scored under every setting."""
    scores = None
    for k, setting in enumerate(grid):
        one = entity_scores(entities.select("s1"), truth, select(best, setting)).agg(F.avg("f05").alias("f")).withColumn("k", F.lit(k))
        scores = one if scores is None else scores.union(one)
    rows = scores.collect()  # one for each setting
    f, setting = max((r.f or 0.0, grid[r.k]) for r in rows)
    return setting, f


#: Parameters of the expected-F rule that are tried.
GAMMAS, MISSES, FLOORS = (0.8, 1.0, 1.25, 1.5, 2.0), (0.0, 0.1, 0.25), (0.05, 0.2, 0.35)


def expected_f_grid(best: DataFrame, entities: DataFrame, truth: DataFrame, *, n_true: DataFrame | None = None, gammas=GAMMAS, misses=MISSES, floors=FLOORS) -> DataFrame:
    """(gamma, missed, floor, f05): the macro F0.5 of the expected-F rule under each setting. The settings are a column: pairs
    are decided by (setting, entity) in one plan, and entities that predict nothing are counted, not multiplied.
    n_true: (s1, n_true) of all entities with a match; truth then needs to hold the true ones of best alone."""
    setting = F.array(*[F.struct(F.lit(float(g)).alias("gamma"), F.lit(float(m)).alias("missed"), F.lit(float(x)).alias("floor")) for g, m, x in itertools.product(gammas, misses, floors)])
    names = ("gamma", "missed", "floor")
    true = truth.select("s1", "eid").distinct().join(entities.select("s1").distinct(), "s1", "left_semi")
    n_true = true.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true")) if n_true is None else n_true.select("s1", "n_true")
    rows = best.select("s1", "eid", "p").join(entities.select("s1").distinct(), "s1", "left_semi").join(true.withColumn("t", F.lit(1)), ["s1", "eid"], "left")
    rows = rows.withColumn("g", F.explode(setting)).select("s1", "eid", "p", "t", "g.*")
    kept = expected_f(rows, floor=F.col("floor"), missed=F.col("missed"), gamma=F.col("gamma"), keys=("s1", *names))
    kept = kept.groupBy("s1", *names).agg(F.count(F.lit(1)).alias("n_pred"), F.count("t").alias("tp")).join(n_true, "s1", "left")
    # an entity that predicts nothing has 1 if it has no match, else 0
    gain = F.try_divide(1.25 * F.col("tp"), 0.25 * F.coalesce("n_true", F.lit(0)) + F.col("n_pred")) - F.when(F.col("n_true").isNull(), 1.0).otherwise(0.0)
    n, alone = entities.select("s1").distinct().join(n_true, "s1", "left").agg(F.count(F.lit(1)), F.count_if(F.col("n_true").isNull())).first()
    sums = kept.groupBy(*names).agg(F.sum(gain).alias("gain"))
    every = best.sparkSession.range(1).select(F.explode(setting).alias("g")).select("g.*")
    return every.join(F.broadcast(sums), list(names), "left").select(*names, ((F.lit(float(alone)) + F.coalesce("gain", F.lit(0.0))) / F.lit(float(max(n, 1)))).alias("f05"))


def tune_expected_f(best: DataFrame, entities: DataFrame, truth: DataFrame, **grid) -> tuple[dict[str, float], float]:
    """The setting with the greatest macro F0.5; of equal ones the greatest."""
    f, *setting = max((round(r.f05, 12), r.gamma, r.missed, r.floor) for r in expected_f_grid(best, entities, truth, **grid).collect())
    return dict(zip(("gamma", "missed", "floor"), setting, strict=True)), f


def tune_thresholds(best: DataFrame, entities: DataFrame, truth: DataFrame, sources: Sequence[str], *, start: float = 0.5, rounds: int = 2, step: float = 0.02, gain: float = 1e-7) -> tuple[dict[str, float], float]:
    """Coordinate ascent over thresholds 0.10, 0.12 ... 0.98. All values of a coordinate are scored in one aggregation: a pair
    that is kept at a threshold is kept at all lower ones, so pairs are counted by the highest they pass."""
    grid = [round(0.10 + step * k, 2) for k in range(int(math.ceil((0.99 - 0.10) / step - 1e-9)))]
    now = dict.fromkeys(sources, start)
    true = truth.select("s1", "eid").distinct().withColumn("t", F.lit(1))
    n_true = true.groupBy("s1").agg(F.count("t").alias("n_true"))
    rows = best.join(true, ["s1", "eid"], "left").select("s1", "src", "p", F.coalesce("t", F.lit(0)).alias("t"))
    base = entities.select("s1").join(n_true, "s1", "left").na.fill(0)

    def score(trials: list[dict[str, float]]) -> list[float]:
        kept = [F.col("p") >= by_source(x, "src", start) for x in trials]
        counts = rows.groupBy("s1").agg(*[c for k, cond in enumerate(kept) for c in (F.count_if(cond).alias(f"p{k}"), F.count_if(cond & (F.col("t") == 1)).alias(f"h{k}"))])
        df = base.join(counts, "s1", "left").na.fill(0)
        f = lambda k: F.when((F.col("n_true") == 0) & (F.col(f"p{k}") == 0), 1.0).otherwise(F.coalesce(F.try_divide(1.25 * F.col(f"h{k}"), 0.25 * F.col("n_true") + F.col(f"p{k}")), F.lit(0.0)))
        return [x or 0.0 for x in df.agg(*[F.avg(f(k)) for k in range(len(trials))]).first()]

    current = score([now])[0]
    for _ in range(rounds):
        for s in sources:
            trials = [now | {s: t} for t in grid]
            for trial, f in zip(trials, score(trials), strict=True):
                if f > current + gain:
                    now, current = trial, f
    return now, current


# -- calibration ------------------------------------------------------------------------


def fit_isotonic(scored: DataFrame, *, prob: str = "p", label: str = "y", n_knots: int = 400) -> dict[str, list[float]]:
    """A monotone piecewise linear map. Quantile bins are counted in Spark; violators are pooled over at most n_knots sums."""
    shares = [k / n_knots for k in range(n_knots + 1)]
    cuts = scored.agg(F.percentile(prob, F.array(*map(F.lit, shares)))).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return {"x": [0.0, 1.0], "y": [TINY, NEAR_ONE]}
    inner = cuts[1:-1] if len(cuts) > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, inner)), lambda c: c <= F.col(prob))) if inner else F.lit(0)
    rows = scored.groupBy(place.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("y"), F.sum(F.col(prob).cast("double")).alias("x")).collect()
    pools: list[list[float]] = []
    for r in sorted(rows):
        pools.append([float(r.n), r.y, r.x])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] > pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    x = [p[2] / p[0] for p in pools]
    y = [min(max(p[1] / p[0], TINY), NEAR_ONE) for p in pools]
    return {"x": [0.0, *x, 1.0], "y": [min(y[0], TINY), *y, max(y[-1], NEAR_ONE)]}


def points_of(knots: Mapping[str, Sequence[float]]) -> Column:
    """Knots as an array of (x, y)."""
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in zip(knots["x"], knots["y"], strict=True)])


def calibrated(p: Column, knots: Mapping[str, Sequence[float]] | Column | None, temperature: float | Column = 1.0) -> Column:
    """The map's value, linear between knots, then its log odds over the temperature. knots: also a column, an array of (x, y)."""
    q = p.cast("double")
    if knots is not None:
        points = knots if isinstance(knots, Column) else points_of(knots)
        low = F.element_at(F.filter(points, lambda k: k["x"] <= F.greatest(q, F.get(points, F.lit(0))["x"])), F.lit(-1))
        high = F.try_element_at(F.filter(points, lambda k: k["x"] > q), F.lit(1))
        q = F.coalesce(low["y"] + (F.greatest(q, low["x"]) - low["x"]) * F.try_divide(high["y"] - low["y"], high["x"] - low["x"]), low["y"])
    if isinstance(temperature, Column) or temperature != 1.0:
        q = shifted(q, F.lit(0.0), 1 / temperature)
    return q


def shifted(q: Column, offset: Column, scale: float | Column = 1.0) -> Column:
    """Log odds times scale plus offset, as a probability."""
    q = F.least(F.greatest(q, F.lit(TINY)), F.lit(NEAR_ONE))
    return 1 / (1 + F.exp(-(F.ln(q / (1 - q)) * scale + offset)))


# -- the exact expected F0.5 ------------------------------------------------------------


#: Greatest k that is tried; counts that are told apart, the last standing for all from there on.
MOST_K, CELLS = 15, 31


def _with_trial(pmf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distributions of counts (a row each) after one more independent trial; the last cell holds all counts from there on."""
    out = pmf * (1 - q)[:, None]
    out[:, 1:] += pmf[:, :-1] * q[:, None]
    out[:, -1] += pmf[:, -1] * q
    return out


def exact_ks(q: np.ndarray, means: np.ndarray, k_max: int = MOST_K, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """q: a row of probabilities for each entity, greatest first, filled up with zeros (trials that never hit); means: expected
    matches that are not among them. By entity, the k whose first k pairs have the greatest expected F0.5, and that; 0 if no
    match at all is likelier."""
    n, width = q.shape
    top = min(width, k_max)
    outside = np.exp(-means)[:, None] * means[:, None] ** np.arange(cells - 1) / np.array([math.factorial(k) for k in range(cells - 1)])
    outside = np.column_stack([outside, np.maximum(0.0, 1.0 - outside.sum(1))])
    for j in range(top, width):
        outside = _with_trial(outside, q[:, j])
    missed = [outside]  # by k, from the last: matches outside the first k
    for j in range(top - 1, -1, -1):
        missed.insert(0, _with_trial(missed[0], q[:, j]))
    best, value = np.zeros(n, int), missed[0][:, 0].copy()
    hits = np.zeros((n, cells))
    hits[:, 0] = 1.0
    count = np.arange(cells)
    for k in range(1, top + 1):
        hits = _with_trial(hits, q[:, k - 1])
        f = 1.25 * count[:, None] / (k + 0.25 * (count[:, None] + count))
        here = np.where(q[:, k - 1] > 0, ((hits @ f) * missed[k]).sum(1), -1.0)
        better = here > value + 1e-12
        best[better], value[better] = k, here[better]
    return best, value


def exact_k(q: Sequence[float], mean: float, k_max: int = MOST_K) -> tuple[int, float]:
    """Of one entity."""
    best, value = exact_ks(np.array([q], float), np.array([mean], float), k_max)
    return int(best[0]), float(value[0])


def exact_f(best: DataFrame, *, lam: float | DataFrame = 0.0, k_max: int = MOST_K, min_p: float = 1e-3, prob: str = "q") -> DataFrame:
    """The pairs of the exact decision, and k_ and ef_ of their entity. lam: expected matches outside the list, or (s1, lam).
    Pairs under min_p only add to it; entities without another predict nothing."""
    q = F.least(F.greatest(F.col(prob).cast("double"), F.lit(0.0)), F.lit(1 - 1e-9))
    df = best.withColumn("q_", q)

    @F.pandas_udf("k int, ef double")
    def solve(lists: pd.Series, means: pd.Series) -> pd.DataFrame:
        lengths = lists.map(len).to_numpy()
        q = np.zeros((len(lists), int(lengths.max(initial=0))))
        q[np.arange(q.shape[1]) < lengths[:, None]] = np.concatenate([*lists, np.zeros(0)])
        best, value = exact_ks(-np.sort(-q, axis=1), means.to_numpy(), k_max)
        return pd.DataFrame({"k": best.astype("int32"), "ef": value})

    # an entity's list is bounded by the rank cut of candidate search
    lists = df.groupBy("s1").agg(F.collect_list(F.when(F.col("q_") >= min_p, F.col("q_"))).alias("qs"), F.sum(F.when(F.col("q_") < min_p, F.col("q_")).otherwise(0.0)).alias("tail"))
    lists = lists.filter(F.size("qs") > 0)
    if isinstance(lam, DataFrame):
        lists = lists.join(lam.select("s1", "lam"), "s1", "left").withColumn("mean", F.coalesce("lam", F.lit(0.0)) + F.col("tail"))
    else:
        lists = lists.withColumn("mean", F.lit(float(lam or 0.0)) + F.col("tail"))
    chosen = lists.select("s1", solve("qs", "mean").alias("d")).select("s1", F.col("d.k").alias("k_"), F.col("d.ef").alias("ef_"))
    ranked = df.filter(F.col("q_") >= min_p).withColumn("n_", F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("q_"), "eid")))
    return ranked.join(chosen, "s1").filter(F.col("n_") <= F.col("k_")).select(*best.columns, "k_", "ef_")


def tune_lam(best: DataFrame, entities: DataFrame, truth: DataFrame, grid: Sequence[float] = (0.0, 0.05, 0.1, 0.2, 0.4)) -> tuple[float, float]:
    (lam,), f = best_of_grid(best, entities, truth, [(x,) for x in grid], lambda b, s: exact_f(b, lam=s[0]))
    return lam, f


def reoffered(scored: DataFrame, best: DataFrame, chosen: DataFrame, select: Callable[[DataFrame], DataFrame], prob: str = "q") -> DataFrame:
    """Records that their best entity rejects are offered to the second best, which keeps them if its decision with them does."""
    names = ["s1", "eid", prob]
    scored, best, chosen = scored.select(*names), best.select(*names), chosen.select(*names)
    rejected = best.join(chosen.select("eid"), "eid", "left_anti").select("eid")
    rest = scored.join(rejected, "eid", "left_semi").join(best.select("s1", "eid"), ["s1", "eid"], "left_anti")
    offers = first_of(rest.select(*names), ["eid"], F.desc(prob), "s1")
    touched = offers.select("s1").distinct()
    again = select(best.join(touched, "s1", "left_semi").select(*names).unionByName(offers)).select(*names)
    return chosen.join(touched, "s1", "left_anti").select(*names).unionByName(again)


# -- shapes -----------------------------------------------------------------------------


def shape_bucket(house_a: Column, house_b: Column, core_a: Column, core_b: Column) -> Column:
    """sibling: b's house is a's plus an offset; samehouse_swap: one house, names that differ by one unlike word; else ''."""
    words = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    only_a, only_b = F.array_except(words(core_a), words(core_b)), F.array_except(words(core_b), words(core_a))

    @F.pandas_udf("boolean")
    def unlike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([bool(p and q and ratio(p, q) < 70) for p, q in zip(x, y, strict=True)], dtype=bool)

    swap = (house_a == house_b) & (house_a != "") & (F.size(only_a) == 1) & (F.size(only_b) == 1)
    delta = house_b.try_cast("bigint") - house_a.try_cast("bigint")
    sibling = F.coalesce(delta.isin(list(SIBLING_OFFSETS)), F.lit(False))
    return F.when(sibling, "sibling").when(swap & unlike(F.get(only_a, F.lit(0)), F.get(only_b, F.lit(0))), "samehouse_swap").otherwise("")


def with_offsets(q: Column, bucket: Column, offsets: Mapping[str, float]) -> Column:
    if not offsets:
        return q
    offset = F.lit(0.0)
    for name, x in offsets.items():
        offset = F.when(bucket == name, F.lit(float(x))).otherwise(offset)
    return shifted(q, offset)
