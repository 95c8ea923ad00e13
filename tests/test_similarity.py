import random

import numpy as np
import pytest
from linkspark.functions import similarity as S
from pyspark.sql import functions as F

SCORERS = (S.ratio, S.token_sort, S.token_set, S.partial, S.jaro_winkler)


def subsequence(a, b):
    """Length of a longest common subsequence, by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def texts(n, seed, longest=24):
    rng = random.Random(seed)
    return ["".join(rng.choices("aabbcde  é9", k=rng.randrange(1, longest))) for _ in range(n)]


def test_ratio_is_by_the_longest_common_subsequence():
    for a, b in zip(texts(400, 1), texts(400, 2), strict=True):
        assert S.ratio(a, b) == pytest.approx(200 * subsequence(a, b) / (len(a) + len(b)))


def test_partial_is_the_best_window():
    for a, b in zip(texts(300, 3, 9), texts(300, 4, 14), strict=True):
        short, long = sorted((a, b), key=len)
        n = len(short)
        windows = [long[max(0, k) : k + n] for k in range(1 - n, len(long))]
        assert S.partial(a, b) == pytest.approx(max(200 * subsequence(short, w) / (n + len(w)) for w in windows))


@pytest.mark.parametrize("scorer", SCORERS)
def test_batches_equal_the_scalar_scores(scorer):
    x = [*texts(500, 5), *texts(30, 6, 200), "same words here", "a b c", "word", "x" * 500, " ", "b a"]
    y = [*texts(500, 7), *texts(30, 8, 200), "here same words", "c b", "word", "y" + "x" * 70, "q", "a b"]
    assert np.allclose(S.BATCHED[scorer](x, y), [scorer(a, b) for a, b in zip(x, y, strict=True)], atol=1e-9)


def test_columns_are_scored_by_pairs(spark):
    rows = [("abc", "abd"), ("abc", "abd"), (None, "x"), ("", "x"), ("one two", "two one")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(S.scored(F.col("a"), F.col("b"), {f.__name__: f for f in SCORERS}).alias("s")).select("s.*").collect()
    for (a, b), r in zip(rows, got, strict=True):
        assert list(r) == pytest.approx([f(a, b) if a and b else -1.0 for f in SCORERS])
