"""String similarities from 0 to 100, for pairs of columns, in Arrow batches.

ratio is the normalised Indel similarity, 2 * (longest common subsequence) / (both
lengths); the token scorers compare sorted or shared words; partial is the best ratio of
the shorter string with a window of the longer. Subsequences are counted with bit
vectors, one machine-word operation a character.

The scalar functions define the scores. Columns are scored by their batch forms, which
work on the code points of all pairs of a batch at once; pairs too long for a machine
word go through the scalar ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _places(s: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(s):
        out[c] = out.get(c, 0) | 1 << k
    return out


def _common(places: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of a string of n characters, given by their places, and other."""
    full = (1 << n) - 1
    row = full
    for c in other:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return n - row.bit_count()


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    if a == b:
        return 100.0
    return 200.0 * _common(_places(a), len(a), b) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not left or not right):
        return 100.0
    base = " ".join(sorted(shared))
    first, second = (f"{base} {left}".strip(), f"{base} {right}".strip())
    best = ratio(first, second)
    if base:
        best = max(best, ratio(base, first), ratio(base, second))
    return best


def partial(a: str, b: str) -> float:
    """The best window has the shorter one's length, or is cut by an end of the longer."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    places, best = _places(a), 0.0
    for start in range(1 - n, len(b)):
        window = b[max(0, start) : start + n]
        if window[-1] not in places and window[0] not in places:
            continue
        best = max(best, 200.0 * _common(places, n, window) / (n + len(window)))
    return best


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    n, m = len(a), len(b)
    if not n and not m:
        return 100.0
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    free = [True] * m
    left: list[str] = []
    for k, c in enumerate(a):
        for j in range(max(0, k - reach), min(m, k + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    t = len(left)
    if not t:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (t / n + t / m + (t - moved) / t) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return 100.0 * (jaro + same * weight * (1 - jaro) if jaro > 0.7 else jaro)


# -- batches ----------------------------------------------------------------------------

#: Characters of the shorter string of a pair that fit a machine word, with a bit to spare.
WORD = 62
#: Cells (pairs times characters of both) of the tables that are made at once.
CELLS = 1 << 21


def _codes(strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, a row for each string, filled up with zeros; lengths)."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    table = np.array(strings, dtype=f"<U{max(1, int(lengths.max(initial=1)))}")
    return table.view(np.uint32).reshape(len(strings), -1), lengths


def _parts(x: Sequence[str], y: Sequence[str]) -> Iterator[np.ndarray]:
    """Places of pairs of like length, as many as CELLS allows."""
    size = np.maximum(np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(map(len, y), np.int64, len(y))) + 1
    order = np.argsort(size, kind="stable")
    start = 0
    while start < len(order):
        end = start + 1
        step = max(1, CELLS // int(size[order[start]]))
        end = min(len(order), start + step)
        while end > start + 1 and (end - start) * int(size[order[end - 1]]) > CELLS:
            end = start + max(1, (end - start) // 2)
        yield order[start:end]
        start = end


def _bits(a: np.ndarray, n: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each character of b, the bits of its places in a."""
    held = np.arange(a.shape[1]) < n[:, None]
    out = np.zeros(b.shape, np.uint64)
    word = np.zeros((len(a), 8), np.uint8)
    for j in range(b.shape[1]):
        packed = np.packbits((a == b[:, j : j + 1]) & held, axis=1, bitorder="little")
        word[:, : packed.shape[1]] = packed
        out[:, j] = word.view(np.uint64)[:, 0]
    return out


def _shorter_first(x: Sequence[str], y: Sequence[str]) -> tuple[list[str], list[str]]:
    both = [(p, q) if len(p) <= len(q) else (q, p) for p, q in zip(x, y, strict=True)]
    return [p for p, _ in both], [q for _, q in both]


def _by_batch(kernel: Callable[[list[str], list[str]], np.ndarray], scalar: Callable[[str, str], float], fits: Callable[[str, str], bool]) -> Callable[[Sequence[str], Sequence[str]], np.ndarray]:
    """A batch form: the kernel for pairs that fit it, the scalar function for others."""

    def run(x: Sequence[str], y: Sequence[str]) -> np.ndarray:
        out = np.zeros(len(x))
        for places in _parts(x, y):
            inside = [k for k in places.tolist() if fits(x[k], y[k])]
            if inside:
                out[inside] = kernel([x[k] for k in inside], [y[k] for k in inside])
            for k in set(places.tolist()).difference(inside):
                out[k] = scalar(x[k], y[k])
        return out

    return run


def _ratios(x: list[str], y: list[str]) -> np.ndarray:
    x, y = _shorter_first(x, y)
    (a, n), (b, m) = _codes(x), _codes(y)
    bits = _bits(a, n, b)
    full = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    row = full.copy()
    for j in range(b.shape[1]):
        hit = row & np.where(j < m, bits[:, j], np.uint64(0))
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (n - np.bitwise_count(row)) / (n + m)


def _partials(x: list[str], y: list[str]) -> np.ndarray:
    x, y = _shorter_first(x, y)
    (a, n), (b, m) = _codes(x), _codes(y)
    bits = _bits(a, n, b)
    full = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    best = np.zeros(len(x))
    widest = int(n.max())
    for start in range(1 - widest, b.shape[1]):
        row = full.copy()
        for j in range(max(0, start), min(b.shape[1], start + widest)):
            hit = row & np.where((j < start + n) & (j < m), bits[:, j], np.uint64(0))
            row = ((row + hit) | (row - hit)) & full
        size = np.minimum(start + n, m) - max(0, start)
        some = (size > 0) & (start > -n)
        best = np.where(some, np.maximum(best, 200.0 * (n - np.bitwise_count(row)) / (n + np.maximum(size, 1))), best)
    return best


def _jaro_winklers(x: list[str], y: list[str], weight: float = 0.1) -> np.ndarray:
    (a, n), (b, m) = _codes(x), _codes(y)
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    places, rows = np.arange(b.shape[1]), np.arange(len(x))
    free = places < m[:, None]
    taken = np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        may = free & (b == a[:, i : i + 1]) & (np.abs(places - i) <= reach[:, None]) & (i < n)[:, None]
        first = may.argmax(1)
        found = may[rows, first]
        free[rows[found], first[found]] = False
        taken[:, i] = found
    t = taken.sum(1)
    used = ~free & (places < m[:, None])
    left = np.take_along_axis(a, np.argsort(~taken, axis=1, kind="stable"), 1)
    right = np.take_along_axis(b, np.argsort(~used, axis=1, kind="stable"), 1)
    both = min(a.shape[1], b.shape[1])
    moved = ((left[:, :both] != right[:, :both]) & (np.arange(both) < t[:, None])).sum(1) // 2
    jaro = np.where(t > 0, (t / n + t / m + (t - moved) / np.maximum(t, 1)) / 3, 0.0)
    lead = min(4, both)
    same = np.cumprod((a[:, :lead] == b[:, :lead]) & (np.arange(lead) < np.minimum(n, m)[:, None]), axis=1).sum(1)
    return 100.0 * np.where(jaro > 0.7, jaro + same * weight * (1 - jaro), jaro)


class JaroWinklers:
    """Jaro-Winkler of any strings with each of a fixed list: a character of one is met with all of the list at once, as bits."""

    #: Cells that are worked on at once: few enough to stay in a processor's cache.
    CELLS = 1 << 13

    def __init__(self, y: Sequence[str]):
        self.y = list(y)
        self.long = [k for k, q in enumerate(self.y) if len(q) > WORD]
        table, self.m = _codes([q if len(q) <= WORD else "" for q in self.y])
        self.codes = np.unique(table)
        self.places = np.zeros((len(self.codes) + 1, len(self.y)), np.uint64)  # the last: of characters that none has
        for j in range(table.shape[1]):
            own = np.flatnonzero(j < self.m)
            self.places[np.searchsorted(self.codes, table[own, j]), own] |= np.uint64(1 << j)
        self.full = (np.uint64(1) << self.m.astype(np.uint64)) - np.uint64(1)

    def scores(self, x: Sequence[str], weight: float = 0.1) -> np.ndarray:
        """A row for each of x."""
        out = np.zeros((len(x), len(self.y)))
        lengths = np.fromiter(map(len, x), np.int64, len(x))
        step = max(1, self.CELLS // max(1, len(self.y)))
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            if not n:
                out[own] = np.where(self.m == 0, 100.0, 0.0)
                continue
            codes = _codes([x[k] for k in own])[0]
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            at = np.where(self.codes[at] == codes, at, len(self.codes))
            reach = np.maximum(0, np.maximum(n, self.m) // 2 - 1)
            bits = lambda k: (np.uint64(1) << np.clip(k, 0, WORD).astype(np.uint64)) - np.uint64(1)
            windows = [self.full & bits(i + reach + 1) & ~bits(i - reach) for i in range(n)]
            for start in range(0, len(own), step):
                out[own[start : start + step]] = self._rows(at[start : start + step], n, windows, weight)
        for k in self.long:
            out[:, k] = [jaro_winkler(p, self.y[k], weight) for p in x]
        return out

    def _rows(self, at: np.ndarray, n: int, windows: list[np.ndarray], weight: float) -> np.ndarray:
        held = [self.places[at[:, i]] for i in range(n)]
        free = np.repeat(self.full[None], len(at), axis=0)
        hits = []
        for own, window in zip(held, windows, strict=True):
            hit = own & window
            hit &= free
            hit &= np.negative(hit)  # the first place
            free ^= hit
            hits.append(hit)
        used = self.full ^ free
        t = np.bitwise_count(used)
        moved = np.zeros(t.shape, np.uint8 if n < 256 else np.int64)
        for own, hit in zip(held, hits, strict=True):
            first = used & np.negative(used)
            first *= hit != 0
            moved += (first & own) != first
            used ^= first
        same, lead = np.zeros(t.shape), np.ones(t.shape, np.uint64)
        for i in range(min(4, n)):
            lead &= held[i] >> np.uint64(i)
            same += lead
        t, m = t.astype(float), np.maximum(self.m, 1)
        jaro = np.where(t > 0, (t / n + t / m + (t - moved // 2) / np.maximum(t, 1)) / 3, 0.0)
        return 100.0 * np.where(jaro > 0.7, jaro + same * weight * (1 - jaro), jaro)


def _in_a_word(a: str, b: str) -> bool:
    return 0 < min(len(a), len(b)) <= WORD


ratios = _by_batch(_ratios, ratio, _in_a_word)


def token_sorts(x: Sequence[str], y: Sequence[str]) -> np.ndarray:
    known = {s: " ".join(sorted(s.split())) for s in {*x, *y}}
    return ratios([known[s] for s in x], [known[s] for s in y])


def token_sets(x: Sequence[str], y: Sequence[str]) -> np.ndarray:
    known = {s: set(s.split()) for s in {*x, *y}}
    out = np.zeros(len(x))
    at: list[int] = []
    first: list[str] = []
    second: list[str] = []
    for k, (a, b) in enumerate(zip(map(known.get, x), map(known.get, y), strict=True)):
        if not a or not b:
            continue
        shared = a & b
        if shared and (shared == a or shared == b):
            out[k] = 100.0
            continue
        base = " ".join(sorted(shared))
        one, two = (f"{base} {' '.join(sorted(z - shared))}".strip() for z in (a, b))
        pairs = [(one, two), (base, one), (base, two)] if base else [(one, two)]
        at += [k] * len(pairs)
        first += [p for p, _ in pairs]
        second += [q for _, q in pairs]
    if at:
        np.maximum.at(out, at, ratios(first, second))
    return out


BATCHED: dict[Callable[[str, str], float], Callable[[Sequence[str], Sequence[str]], np.ndarray]] = {
    ratio: ratios,
    token_sort: token_sorts,
    token_set: token_sets,
    partial: _by_batch(_partials, partial, _in_a_word),
    jaro_winkler: _by_batch(_jaro_winklers, jaro_winkler, lambda a, b: bool(a and b)),
}


def batch_scores(x: pd.Series, y: pd.Series, scorer: Callable[[str, str], float]) -> np.ndarray:
    """-1 where either side is null or empty. Equal pairs of a batch are scored once."""
    out = np.full(len(x), -1.0)
    places: dict[tuple[str, str], list[int]] = {}
    for k, pair in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        if pair[0] and pair[1]:
            places.setdefault(pair, []).append(k)
    if places:
        left, right = zip(*places, strict=True)
        if scorer in BATCHED:
            found = BATCHED[scorer](left, right)
        else:
            found = np.array([scorer(p, q) for p, q in places])
        counts = [len(k) for k in places.values()]
        out[[k for own in places.values() for k in own]] = np.repeat(found, counts)
    return out


def scored(a: Column, b: Column, scorers: dict[str, Callable[[str, str], float]]) -> Column:
    """A struct with a double for each scorer; -1 where either side is null or empty."""
    return all_scored([(n, a, b, f) for n, f in scorers.items()])


def all_scored(pairs: list[tuple[str, Column, Column, Callable[[str, str], float]]]) -> Column:
    """One struct for many (name, left, right, scorer): a single pass through Python. A column that several pairs have goes once."""
    schema = ", ".join(f"`{n}` double" for n, *_ in pairs)
    columns: dict[str, Column] = {}
    for _, a, b, _ in pairs:
        columns.setdefault(str(a), a)
        columns.setdefault(str(b), b)
    place = {k: n for n, k in enumerate(columns)}
    plan = [(n, place[str(a)], place[str(b)], f) for n, a, b, f in pairs]

    @F.pandas_udf(schema)
    def run(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({n: batch_scores(columns[i], columns[j], f) for n, i, j, f in plan}, dtype="float64")

    return run(*columns.values())

