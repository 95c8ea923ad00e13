"""Small tables with the odd cases, and brute-force versions."""

import random
import re

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_documents(spark, extra=()):
    long = " ".join(f"word{k}" for k in range(3000))
    rows = [
        (5, "alpha beta gamma", "en", "b"), (3, None, "en", None), (9, "", None, "a"), (7, " \t\n", "en", "a"),
        (2, "alpha  beta\ngamma", "en", "b"), (2, "alpha  beta\ngamma", "en", "b"), (11, long, "en", "c"), (12, long + " end", "en", "c"),
        (13, "Ünïcode ΑΣ ﬁ İ 日本語 <|endoftext|> x\x1cy", "de", "d"), (14, "###", "en", "d"), (15, "$$$", "en", "d"), *extra,
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOC_SCHEMA)
    # names that operators use inside
    for c in ("size", "key_", "range_", "host", "digest_", "class_id", "features", "words", "position"):
        df = df.withColumn(c, df["lang"])
    return df


def random_words(n, seed, size=900):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edited(words, n, seed):
    rng = random.Random(seed)
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[k] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, f"new{rng.randrange(10**6)}")
    return out


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def aligned_similarity(a, b):
    """Matches of a longest common subsequence of 5-word shingles over (both - matches), by the full table."""
    sh = lambda w: [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))]
    x, y = sh(a), sh(b)
    row = [0] * (len(y) + 1)
    for p in x:
        new = [0]
        for j, q in enumerate(y):
            new.append(row[j] + 1 if p == q else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(x) + len(y) - row[-1])


def near_groups(docs):
    """docs: {id: text}. The least id of each class, by all pairs."""
    ids = sorted(docs)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = words_of(docs[i]), words_of(docs[j])
            if (a == b and a) or (not a and not b and (docs[i] or "") == (docs[j] or "")) or (a and b and min(len(a), len(b)) >= 0.7 * max(len(a), len(b)) and aligned_similarity(a, b) >= 0.8 - 1e-9):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
