"""Toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order; a later model sees the features of the text
and the probabilities that the models before it give. For fitting, those are out-of-fold
predictions, so that a later model learns how far the earlier ones can be trusted on
texts they have not seen; the features of a fold's models are selected without its labels. Models are logistic regressions with an L1 penalty over the
words of the whole text, their prefixes (for inflected or compounded words) and its
runs of symbols, each by how often and how densely it occurs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import mapped, share_below, stored

#: Labelled rows that a fit reads at most, about; chosen by hash.
MAX_FIT = 6000
#: Features of a fit, those that say most about any category.
MAX_FEATURES = 2000
#: Tasks that read the sample.
FIT_TASKS = 12
FOLDS, PENALTY, STEPS = 3, 1.0, 120
PREFIXES, SYMBOL_PREFIXES = (4, 5, 6), (3,)
#: Texts with fewer rows than this share of the fit's have no feature of their own.
LEAST_ROWS = 4
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]{2,}")
MAX_CACHED = 150_000


def token_features(token: str) -> list[int]:
    names = [token, *(f"{token[:n]}*" for n in (PREFIXES if token[0].isalpha() else SYMBOL_PREFIXES) if len(token) > n)]
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) for x in names]


#: A feature stands for a word, prefix or run that occurs at least so often and, of the text's tokens, at this rate.
LEVELS = ((1, 0.0), (2, 0.0), (4, 0.0), (2, 1 / 150), (2, 1 / 60))


def tokens(text: str) -> Counter:
    return Counter(TOKEN.findall(text.lower()))


def text_features(text: str) -> list[int]:
    found: Counter = Counter()
    words = tokens(text)
    for t, n in words.items():
        for f in token_features(t):
            found[f] += n
    total = words.total()
    return sorted({(f + k * 0x9E3779B1) & 0xFFFFFFFF for f, n in found.items() for k, (least, rate) in enumerate(LEVELS) if n >= least and n >= rate * total})


class Chain(NamedTuple):
    categories: tuple[str, ...]
    features: np.ndarray  # hashes, sorted
    weights: np.ndarray  # a row for each category
    bias: np.ndarray
    earlier: np.ndarray  # weights of the probabilities of the categories before
    threshold: float  # of the last category

    def odds(self, features: np.ndarray) -> np.ndarray:
        """Log odds by category, for the places of a text's features."""
        out = np.zeros(len(self.categories))
        for k in range(len(out)):
            out[k] = self.bias[k] + self.weights[k, features].sum() + self.earlier[k, :k] @ _sigmoid(out[:k])
        return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int], y: np.ndarray, extra: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """L1 logistic regression by accelerated proximal steps: weights of the 0/1 features (at rows, columns), of the dense extra columns, and the bias."""
    n, m = shape
    share = (y.sum() + 0.5) / (n + 1)
    w, e, b = np.zeros(m), np.zeros(extra.shape[1]), float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return w, e, b
    # a bound of each column's curvature by how many features share its rows would be small steps; these are by column
    size = np.bincount(rows, minlength=n) + 1.0
    scale = np.bincount(columns, size[rows], minlength=m) / 4 + 1e-9
    scale_e = (extra**2 * size[:, None]).sum(0) / 4 + 1e-9
    scale_b = size.sum() / 4
    v, ve, vb, t = w, e, b, 1.0
    for _ in range(steps):
        p = _sigmoid(np.bincount(rows, v[columns], minlength=n) + extra @ ve + vb)
        g = p - y
        new = v - np.bincount(columns, g[rows], minlength=m) / scale
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / scale, 0)
        new_e = ve - extra.T @ g / scale_e
        new_b = vb - g.sum() / scale_b
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, ve, vb = new + (old - 1) / t * (new - w), new_e + (old - 1) / t * (new_e - e), new_b + (old - 1) / t * (new_b - b)
        w, e, b = new, new_e, new_b
    return w, e, b


def _selected(rows: DataFrame, categories: Sequence[str], most: int) -> list[np.ndarray]:
    """The features of rows (fold_, text_, labels) that say most about any category, by a chi-square against
    independence: of the rows outside each fold, and at last of all rows. Counts are added up by task, then by
    feature; only the selected ones come to the driver."""
    width = 1 + len(categories)
    sums = {r.fold_: [r.n, *(r[c] for c in categories)] for r in rows.groupBy("fold_").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).collect()}
    sums = np.array([sums.get(f, [0] * width) for f in range(FOLDS)], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = [c.to_pylist() for c in batch.columns[2:]]
            for k, text in enumerate(batch.column(1).to_pylist()):
                fold = batch.column(0)[k].as_py()
                own = np.array([1, *(y[k] for y in labels)])
                for f in text_features(text):
                    if f not in counts:
                        counts[f] = np.zeros((FOLDS, width), np.int32)
                    counts[f][fold] += own
        flat = np.array(list(counts.values()), np.int64).reshape(len(counts), FOLDS * width)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), *[pa.array(x) for x in flat.T]], names)

    cell = lambda f, k: f"c{f * width + k}"
    names = ["feature", *(cell(f, k) for f in range(FOLDS) for k in range(width))]
    counts = stored(mapped(rows, run, ", ".join(f"{c} bigint" for c in names)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in names[1:]]), "counts")
    found = []
    for left_out in [*range(FOLDS), None]:
        folds = [f for f in range(FOLDS) if f != left_out]
        n, *ones = sums[folds].sum(0)
        of = [sum((F.col(cell(f, k)) for f in folds[1:]), F.col(cell(folds[0], k))) for k in range(width)]
        shares = [float(min(max(y / max(n, 1), 1e-6), 1 - 1e-6)) for y in ones]
        chi = [F.pow(F.col("n") * -s + F.col(f"y{k}"), 2) / (F.col("n") * (s * (1 - s))) for k, s in enumerate(shares)]
        top = counts.select("feature", of[0].alias("n"), *[x.alias(f"y{k}") for k, x in enumerate(of[1:])])
        top = top.filter(F.col("n") >= min(LEAST_ROWS, max(n, 1))).select("feature", F.greatest(*chi, F.lit(0.0)).alias("best")).filter("best > 0").orderBy(F.desc("best"), "feature").limit(most)
        found.append(np.array(sorted(r.feature for r in top.collect()), np.uint32))
    return found


def _matrix(rows: DataFrame, categories: Sequence[str], names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rows' selected features, folds and labels on the driver, in the order of their keys: (row of each feature, place of each, folds, labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: k for k, f in enumerate(names.tolist())}
        for batch in batches:
            found = [[place[f] for f in text_features(text) if f in place] for text in batch.column(2).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.array([f for x in found for f in x], np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *batch.columns[3:]], ["key_", "fold_", "features", *categories])

    table = mapped(rows.select("key_", "fold_", "text_", *categories), run, "key_ bigint, fold_ int, features array<int>, " + ", ".join(f"`{c}` int" for c in categories)).toArrow().sort_by("key_").combine_chunks()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, int), np.zeros((0, len(categories)))
    lists = table.column("features").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    y = np.stack([table.column(c).to_numpy() for c in categories], 1).astype(float)
    return np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), table.column("fold_").to_numpy(), y


def fit(documents: DataFrame, labels: DataFrame, categories: Sequence[str] = ("quality", "toxic"), *, id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT, max_features: int = MAX_FEATURES) -> Chain:
    """A chain from a sample of about max_fit labelled rows; categories are 0/1 columns of labels, in the chain's order.

    Rows with a null label are left out, ids without a document are too. Of labels that
    contradict each other for an id the greater counts. Folds follow a hash of the id, so
    reruns agree. Without any row or with one class only, a category's probability is
    the share of its labels. max_features: of each fit, those that say most.
    """
    known = labels.select(F.col(id_col), *categories).dropna().groupBy(id_col).agg(*[F.max(c).cast("int").alias(c) for c in categories])
    sample = known.filter(share_below(known, id_col, max_fit))
    text = documents.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col)), F.lit(FOLDS)).cast("int").alias("fold_")
    rows = text.join(F.broadcast(sample), id_col).select(F.xxhash64(id_col).alias("key_"), fold, "text_", *categories)
    rows = stored(rows.repartition(FIT_TASKS), "labelled")
    selected = _selected(rows.select("fold_", "text_", *categories), categories, max_features)
    names = np.unique(np.concatenate(selected))
    row, column, folds, y = _matrix(rows, categories, names)
    n, k = len(y), len(categories)
    if not n:
        return Chain(tuple(categories), np.zeros(0, np.uint32), np.zeros((k, 0)), np.full(k, -8.0), np.zeros((k, k)), 0.5)
    weights, bias, earlier, outside = np.zeros((k, len(names))), np.zeros(k), np.zeros((k, k)), np.zeros((n, k))
    for c in range(k):
        extra = _sigmoid(outside[:, :c])
        for f in range(FOLDS):
            train, test = folds != f, folds == f
            if not train.any() or not test.any():
                continue
            number = np.cumsum(train) - 1
            here = train[row] & np.isin(names, selected[f])[column]
            w, e, b = logistic(number[row[here]], column[here], (int(train.sum()), len(names)), y[train, c], extra[train])
            outside[test, c] = (np.bincount(row, w[column], minlength=n) + extra @ e + b)[test]
        here = np.isin(names, selected[-1])[column]
        weights[c], earlier[c, :c], bias[c] = logistic(row[here], column[here], (n, len(names)), y[:, c], extra)
    truth = y[:, -1] > 0
    order = np.argsort(-outside[:, -1], kind="stable")
    right = np.cumsum(truth[order])
    score = 2 * right / (np.arange(1, n + 1) + truth.sum() + 1e-9)
    at = int(np.argmax(score))
    between = outside[order[at : at + 2], -1].mean() if truth.any() else 0.0
    threshold = float(np.clip(_sigmoid(between), 0.2, 0.8))
    some = np.abs(weights).max(0) > 0 if len(names) else np.zeros(0, bool)
    return Chain(tuple(categories), names[some], weights[:, some], bias, earlier, threshold)


class _Scorer:
    """Scores the texts of one task."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.place = {h: k for k, h in enumerate(chain.features.tolist())}
        # what a token's feature can lead to: (level, place)
        self.of: dict[int, list[tuple[int, int]]] = {}
        for h, k in self.place.items():
            for n in range(len(LEVELS)):
                self.of.setdefault((h - n * 0x9E3779B1) & 0xFFFFFFFF, []).append((n, k))
        self.seen: dict[str, tuple[int, ...]] = {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Probabilities, a row for each text; null counts as empty."""
        out = np.zeros((len(texts), len(self.chain.categories)))
        seen, of = self.seen, self.of
        for k in range(len(texts)):
            if len(seen) > MAX_CACHED:
                seen.clear()
            counts: dict[int, int] = {}
            words = tokens(texts[k].as_py() or "")
            for t, n in words.items():
                if (features := seen.get(t)) is None:
                    features = seen[t] = tuple(f for f in token_features(t) if f in of)
                for f in features:
                    counts[f] = counts.get(f, 0) + n
            total = words.total()
            found = sorted({place for f, n in counts.items() for level, place in of[f] if n >= LEVELS[level][0] and n >= LEVELS[level][1] * total})
            out[k] = self.chain.odds(np.array(found, np.int64))
        return _sigmoid(out)


def score(df: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, p_<category> double for each of the chain, and reject boolean (the last category's is above the threshold).

    Reads whole texts; null counts as empty. Repeated rows stay and score alike. An
    empty table gives an empty one. Other columns are not looked at.
    """
    columns = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(chain)
        for batch in batches:
            p = scorer(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, c]) for c in range(len(columns))], pa.array(p[:, -1] > chain.threshold)], [id_col, *columns, "reject"])

    rows = df.select(id_col, text_col)
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"`{c}` double" for c in columns) + ", reject boolean"
    return mapped(rows, run, schema)


def without_toxic(df: DataFrame, chain: Chain, *, text_col: str = "text") -> DataFrame:
    """The rows of df that the chain does not reject, with all their columns. Nothing is shuffled."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(chain)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at))[:, -1] <= chain.threshold))

    return mapped(df, run, df.schema)
