import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from linkspark.llm import bpe, cascade, cdc, dedup, langid, mixing, omh, pagediff, tokenfile, toxicity
from linkspark.llm.queries import oracle_sql, queries, tokenizer_path
from oracle import connection, differences
from pyspark.sql import functions as F

from conftest import SF, TINY

from .fixtures import DOC_SCHEMA, aligned_similarity, edited, near_groups, odd_documents, random_words


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    assert differences(queries()[name](spark, SF).toPandas(), connection(SF).execute(oracle_sql()[name]).fetchdf()) == ""


# -- 1 ----------------------------------------------------------------------------------


def test_mix_reaches_targets(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.randrange(40)), "en", rng.choice(["a", "b", "c", "a", "a", None]), 0) for k in range(600)]
    plan = mixing.plan(spark.createDataFrame(rows, DOC_SCHEMA), weights=(5.0, 1.0, 2.0)).join(spark.createDataFrame(rows, DOC_SCHEMA).select("doc_id", "source"), "doc_id").collect()
    taken, size, target = Counter(), Counter(), {}
    for r in plan:
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"] and r["size"] == len(rows[r.doc_id][1].split())
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in target:
        assert abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * size[s] + 1e-9
    weight = dict(zip(sorted(x for x in size if x) + [None], (5.0, 1.0, 2.0, 5.0), strict=True))
    free = [s for s in size if target[s] < 2 * size[s] - 1e-6]
    assert len({round(target[s] / weight[s], 6) for s in free}) <= 1


def test_schedule_inverts_demand(spark):
    knots = ((0.0, 2.0), (0.25, 0.0), (0.5, 0.0), (1.0, 3.0))
    t = [r[0] for r in spark.range(101).select(mixing.inverse_demand(F.col("id") / 100, knots)).collect()]
    assert t == sorted(t) and t[0] == 0.0 and t[-1] == pytest.approx(1.0)
    grid = np.linspace(0, 1, 200_001)
    demand = np.cumsum(np.interp(grid, *zip(*knots, strict=True)))
    for k in (10, 33, 50, 90):
        assert np.interp(t[k], grid, demand / demand[-1]) == pytest.approx(k / 100, abs=1e-3)


def test_mix_odd_rows(spark, odd, empty):
    rows = mixing.plan(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, mixed.collect()))


# -- 2, 8 -------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, odd, library):
    for r in bpe.encode(odd, tokenizer_path(), *bpe.COLUMNS).join(odd.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


@pytest.mark.parametrize("kind", [bpe.WordBpe, bpe.LibraryBpe])
def test_bpe_on_random_text(library, kind):
    coder = kind(tokenizer_path(), max_held=20_000)  # tables are emptied again and again
    rng = random.Random(4)
    alphabet = "aabcdeghinorstt'.,!?éÜßñ日本語ΑΣς̈ﬁİ \t\n\x1c\x85  012९٣<|>—😀​"
    for k in range(300):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) + "<|endoftext|>x" * (n == k % 40) for n in range(10)]
        found = coder.encode_block(pa.array(["not looked at", *texts]).slice(1))
        for text, ids in zip(texts, np.split(found.ids, np.cumsum(found.counts)[:-1]), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_word_of_any_length_needs_the_states_of_one_path():
    coder = bpe.WordBpe(tokenizer_path())
    word = "abcdefghij" * 30_000
    tracemalloc.start()
    found = coder.encode_block(pa.array([word, word[:-1] + " x"]))
    assert tracemalloc.get_traced_memory()[1] < 60 << 20 and found.counts.min() > 1000
    tracemalloc.stop()
    assert coder.decode(found)[0].as_py().replace(" ", "") == word + "</w>"
    coder.clear()
    assert not coder._piece.new and not coder._word.new and not coder._follows


def test_bpe_empty_and_decode(spark, empty):
    assert bpe.encode(empty, tokenizer_path()).count() == 0
    df = bpe.encode(spark.createDataFrame([(1, "Some text, here")], "doc_id bigint, text string"), tokenizer_path(), "ids", "decoded")
    r = bpe.decode(df, tokenizer_path(), out_col="again").first()
    assert r.again == r.decoded


def test_token_files(spark, odd, library, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(odd, path, tokenizer_path(), rows_per_file=3)
    got = tokenfile.starts(tokenfile.checksums(spark, path), tokenfile.file_sums(spark, path)).orderBy("start").collect()
    start = 0
    for r, (doc, text) in zip(got, sorted((r.doc_id, r.text or "") for r in odd.collect()), strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    import pyarrow.parquet as pq

    file = next(p for p in sorted(tmp_path.glob("tokens/part-*.parquet")) if pq.ParquetFile(p).metadata.num_rows)
    group = pq.ParquetFile(file).metadata.row_group(0)
    by = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert by["doc_id"].encodings and "DELTA_BINARY_PACKED" in by["doc_id"].encodings and by["doc_id"].has_offset_index
    assert any("DICTIONARY" in e for e in by["ids.list.element"].encodings)


def test_token_files_of_an_empty_table(spark, empty, tmp_path):
    path = f"file://{tmp_path}/none"
    tokenfile.write_tokens(empty, path, tokenizer_path())
    assert tokenfile.starts(tokenfile.checksums(spark, path), tokenfile.file_sums(spark, path)).count() == 0


# -- 3 ----------------------------------------------------------------------------------


def planted(n_groups=12, seed=3):
    docs, k = {}, 0
    for g in range(n_groups):
        base = random_words(60 + 40 * g, seed + g)
        for n in (0, 1, 1 + g // 3, 2 + g // 2, 30):
            docs[k * 7 % 1009] = " ".join(edited(base, n, 100 * g + n))
            k += 1
    docs[2000], docs[2001], docs[2002], docs[2003], docs[2004] = "", " ", "###", "one two", "One, two!"
    return docs


def test_near_classes_equal_all_pairs(spark):
    docs = planted()
    rows = [(i, t, "en", "s", 0) for i, t in docs.items()] + [(5000, None, "en", "s", 0)]
    docs[5000] = ""
    got = {r.doc_id: r.class_id for r in omh.near_classes(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    assert got == near_groups(docs)


def test_a_large_group_of_near_copies_is_one_class(spark):
    base = random_words(150, 8)
    rows = [(k, " ".join(edited(base, k % 3, k)), "en", "s", 0) for k in range(60)] + [(100 + k, " ".join(random_words(150, 50 + k)), "en", "s", 0) for k in range(10)]
    got = {r.doc_id: (r.class_id, r.class_size) for r in omh.near_classes(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    assert {got[k] for k in range(60)} == {(0, 60)} and all(got[100 + k] == (100 + k, 1) for k in range(10))


def test_pairs_inside_one_large_bucket(spark):
    passage, rows, pairs = random_words(176, 9), [], []
    sketched = lambda w: omh.sketch(omh.word_hashes(" ".join(w)))
    others = np.array([sketched(passage + random_words(28, 10 + k)) for k in range(12)])
    for k in range(1000):
        tail = random_words(8, 1000 + k)
        one, two = (passage + tail + random_words(20, 2000 + 2 * k + x) for x in (0, 1))
        a, b = sketched(one), sketched(two)
        if len(pairs) < 4 and not ((a == b) & (a != others).all(0)).any():  # they share the passage's buckets only
            pairs.append((2 * k, 2 * k + 1))
            rows += [(2 * k, " ".join(one), "en", "s", 0), (2 * k + 1, " ".join(two), "en", "s", 0)]
    assert len(pairs) == 4
    rows += [(5000 + k, " ".join(passage + random_words(28, 5000 + k)), "en", "s", 0) for k in range(300)]
    labelled = {r[0]: omh.labelled(omh.shingles(omh.word_hashes(r[1]))) for r in rows}
    assert [(a, b) for a in labelled for b in labelled if a < b and omh.similarity(labelled[a], labelled[b]) >= 0.8] == pairs
    got = {r.doc_id: r.class_id for r in omh.near_classes(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    assert got == {x: x for x in labelled} | {b: a for a, b in pairs}


def test_banded_alignment_equals_the_full_table():
    for k in range(60):
        a = random_words(40 + k, k, size=30)
        b = edited(a, k % 9, k)
        one, two = (omh.labelled(omh.shingles(omh.word_hashes(" ".join(w)))) for w in (a, b))
        full = aligned_similarity(a, b)
        banded = omh.similarity(one, two, 0.5)
        assert banded <= full + 1e-9 and (banded == pytest.approx(full) or full < 0.8 or len(set(a)) < len(a))


def test_near_copies_odd_rows(spark, odd, empty):
    got = {r.doc_id: r.class_id for r in omh.near_classes(odd).collect()}
    assert got[5] == 2 and got[9] == 3 and got[12] == 11 and got[14] == 14 and got[15] == 15 and got[7] == 7
    assert omh.near_classes(empty).count() == 0 and omh.without_near_copies(odd).columns == odd.columns


# -- 4 ----------------------------------------------------------------------------------


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in cascade.RULES if (host == r[1].split("/")[0] or host.endswith("." + r[1].split("/")[0])) and path.startswith("/" + r[1].split("/", 1)[1])]
    if fits:
        kind, rule = min(fits, key=lambda r: (-len(r[1]), r[1]))
        return host, path, rule, kind
    return host, path, None, "block" if any(host == x or host.endswith("." + x) for x in cascade.LISTED) else "allow"


def test_urls(spark):
    urls = ["http://Example.ORG/es/x", "https://a.example.org/en/12?q#z", "http://x.com/fr/", "http://com/de/1", "http://x.com", "ftp://spam-farm.example.net/a", "https://m.casino-win.example.com?x", "no url", None, "", "a://b://c/d", "http://notexample.org/es/", "http://spam-farm.example.net.evil/x", "http://ÀB.org/é#x", "http:///path", "http://x.org"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in cascade.judge(df).collect()}
    assert got == {k: judged(u) for k, u in enumerate(urls)}
    assert cascade.judge(df.limit(0)).count() == 0
    listing = df.sparkSession.createDataFrame([("x.com",), ("x.com",), (None,)], "any string")
    assert {r.page_id for r in cascade.judge(df, wanted=listing).filter("listed").collect()} == {2, 4}
    long = spark.createDataFrame([(1, "http://" + "a." * 3000 + "spam-farm.example.net/" + "p" * 100_000)], "page_id int, url string")
    assert cascade.judge(long).first().listed


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("h"), "id").alias("key_"))
    wanted = [f"h{k}" for k in range(0, 20_000, 37)] + ["absent"]
    listing = spark.createDataFrame([(x,) for x in wanted], "host string")
    bits = []
    for local_keys in (cascade.LOCAL_KEYS, 100, 0):  # levels made on the driver, by Spark, or both
        made = cascade.build(universe, listing, local_keys)
        rows = universe.select("key_", cascade.hit(made)(F.array(cascade.hashes(F.col("key_"))))[0].alias("x")).collect()
        assert {r.key_ for r in rows if r.x} == set(wanted) - {"absent"} and len(made.levels) > 2
        bits.append([x.words.tolist() for x in made.levels])
    assert bits[0] == bits[1] == bits[2]
    assert cascade.build(universe, spark.createDataFrame([("absent",)], "host string")).levels == []


# -- 5 ----------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("0.01", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train = toxicity.fit(docs, labels.filter("doc_id % 3 <> 0"))
    got = toxicity.score(docs.join(labels.filter("doc_id % 3 = 0"), "doc_id", "left_semi"), train).join(labels, "doc_id").select("toxic", "reject").toPandas()
    recall = (got.reject & (got.toxic == 1)).sum() / (got.toxic == 1).sum()
    false = (got.reject & (got.toxic == 0)).sum() / (got.toxic == 0).sum()
    assert recall > 0.85 and false < 0.01
    wide = toxicity.score(docs, toxicity.fit(docs, labels, max_features=2 * toxicity.MAX_FEATURES)).select("doc_id", F.col("reject").alias("wide"))
    narrow = toxicity.score(docs, toxicity.fit(docs, labels)).join(wide, "doc_id")
    assert narrow.filter("reject <> wide").count() <= 0.002 * docs.count()  # the bound on features hardly matters


def plain_logistic(x, extra, y, steps=20_000):
    """L1 logistic regression by many small proximal steps on dense columns; the penalty is on the columns of x alone."""
    x, n = np.hstack([x, extra, np.ones((len(y), 1))]), x.shape[1]
    w, rate = np.zeros(x.shape[1]), 4 / np.linalg.norm(x, 2) ** 2
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if y.min() == y.max():
        return w[:n], w[n:-1], w[-1]
    for _ in range(steps):
        w = w - rate * x.T @ (1 / (1 + np.exp(-x @ w)) - y)
        w[:n] = np.sign(w[:n]) * np.maximum(np.abs(w[:n]) - rate * toxicity.PENALTY, 0)
    return w[:n], w[n:-1], w[-1]


def test_the_chain_equals_a_plain_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 3000)
    monkeypatch.setattr(toxicity.logistic, "__defaults__", (toxicity.PENALTY, 3000))
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(90):
        bad, poor = k % 3 == 0, k % 2
        words = [rng.choice("tree house water stone road light".split()) for _ in range(12)]
        words += ["rude"] * (bad and k % 4 > 0) + ["vile"] * (bad and k % 5 > 1) + ["sloppy"] * (poor and k % 7 > 0)
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1 - poor, int(bad)))
    docs, known = spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    chain = toxicity.fit(docs, known)
    fold = {r.doc_id: r.f for r in known.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    folds = np.array([fold[k] for k in range(90)])
    y = np.array([x[1:] for x in labels], float)
    features = [set(toxicity.text_features(r[1])) for r in rows]
    names = sorted(set().union(*features))
    x = np.array([[f in own for f in names] for own in features], float)

    def usable(part):  # support and some relation to a category
        n, sums = x[part].sum(0), y[part].mean(0)
        chi = np.max([np.abs(x[part].T @ y[part, c] - n * sums[c]) for c in (0, 1)], 0)
        return (n >= toxicity.LEAST_ROWS) & (chi > 1e-9)

    extra, odds = np.zeros((90, 0)), []
    for c in (0, 1):
        outside = np.zeros(90)
        for f in range(toxicity.FOLDS):
            train, own = folds != f, usable(folds != f)
            w, e, b = plain_logistic(x[train][:, own], extra[train], y[train, c])
            outside[folds == f] = (x[:, own] @ w + extra @ e + b)[folds == f]
        own = usable(np.ones(90, bool))
        w, e, b = plain_logistic(x[:, own], extra, y[:, c])
        odds.append((own, w, e, b))
        extra = np.column_stack([extra, 1 / (1 + np.exp(-outside))])
    p = np.zeros((90, 0))
    for own, w, e, b in odds:
        p = np.column_stack([p, 1 / (1 + np.exp(-(x[:, own] @ w + p @ e + b)))])
    got = {r.doc_id: (r.p_quality, r.p_toxic) for r in toxicity.score(docs, chain).collect()}
    assert np.abs(np.array([got[k] for k in range(90)]) - p).max() < 0.02
    again = toxicity.fit(docs.repartition(3), known.unionByName(known.withColumns({"quality": F.lit(0), "toxic": F.lit(0)})))
    assert (again.features == chain.features).all() and np.allclose(again.weights, chain.weights)  # of contradicting labels the greater counts


def test_toxicity_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    chain = toxicity.fit(odd, none)
    assert not any(r.reject for r in toxicity.score(odd, chain).collect())
    one = spark.createDataFrame([(5, 1, 0), (2, 1, None), (999, 0, 1)], none.schema)
    chain = toxicity.fit(odd, one)
    assert toxicity.score(empty, chain).count() == 0 and toxicity.without_toxic(odd, chain).count() == odd.count()


# -- 6 ----------------------------------------------------------------------------------


def test_languages(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = langid.identify(pages, model).toPandas()
    assert len(got) == pages.count() and (got.lang == got.declared).mean() > 0.97
    blind = langid.identify(pages.withColumn("html", F.regexp_replace("html", "<html[^>]*>", "<html>")), model).toPandas()
    assert (blind.sort_values("page_id").lang.values == got.sort_values("page_id").lang.values).mean() > 0.97


def test_fusion_equals_a_plain_computation(spark):
    docs = spark.createDataFrame([(1, "the house of the stone", "en"), (2, "das haus und der stein", "de"), (3, "la maison de la pierre", "fr")], "doc_id bigint, text string, lang string")
    model = langid.fit(docs, max_fit=100)
    texts = ["the stone", "das haus", "la pierre", "the house of stone", "", "zz"]
    rows = [(k, f"http://{'abc'[k % 3]}.site{k % 2}.{('com', 'de')[k % 2]}/{k}", f"<html lang='{('en', 'de', 'fr', '')[k % 4]}'><p>{texts[k % 6]}</p>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in langid.identify(pages, model).collect()}
    count, prior = len(model.languages), langid.PRIOR
    ll, q, host, declared = {}, {}, {}, {}
    for k, url, page in rows:
        words = texts[k % 6].split()
        grams = [w[i : i + 3] for w in (f" {x} " for x in words) for i in range(len(w) - 2)]
        ll[k] = sum((model.weights[model.grams.get(g, len(model.grams))] for g in grams), np.zeros(count))
        q[k] = np.exp(ll[k] - ll[k].max()) / np.exp(ll[k] - ll[k].max()).sum()
        host[k], declared[k] = url.split("/")[2], page.split("'")[1]
    total = sum(q.values())
    corpus = (total + 1) / (total.sum() + count)

    def by(value, k):
        own = [j for j in q if value(j) == value(k)]
        return np.log((sum(q[j] for j in own) + prior * len(own) / total.sum()) / (total + prior))

    for k in q:
        name = lambda j: ".".join(host[j].split(".")[-2:])
        named = [j for j in q if name(j) == name(k)]
        of_name = (sum(q[j] for j in named) + prior * corpus) / (len(named) + prior)
        beside = [j for j in q if host[j] == host[k]]
        of_host = np.log((np.maximum(sum(q[j] for j in beside) - q[k], 0) + prior * of_name) / (len(beside) - 1 + prior))
        fused = ll[k] + by(lambda j: declared[j], k) + by(lambda j: host[j].split(".")[-1], k) + of_host
        p = np.exp(fused - fused.max()) / np.exp(fused - fused.max()).sum()
        assert got[k].lang == model.languages[int(fused.argmax())] and got[k].p == pytest.approx(p.max(), abs=1e-9)


def test_declared_language_anywhere_in_the_page(spark):
    model = langid.fit(spark.read.parquet(f"{TINY}/documents.parquet"))
    heads = [(1, "<!-- " + "licence " * 2000 + "-->"), (2, " " * 9000), (3, "<!-- <html lang='fr'> -->"), (4, "")]
    pages = spark.createDataFrame([(k, "http://a.b/x", head + "<HTML class='x' lang='de'><p>eins</p></html>") for k, head in heads] + [(5, "http://a.b/y", "<html><p lang='fr'>x")], "page_id bigint, url string, html string")
    got = {r.page_id: r.declared for r in langid.identify(pages, model).collect()}
    assert got == {1: "de", 2: "de", 3: "de", 4: "de", 5: ""}


def test_languages_odd_rows(spark, empty):
    model = langid.fit(spark.read.parquet(f"{TINY}/documents.parquet"))
    pages = spark.createDataFrame([(1, None, None), (2, "", ""), (2, "", ""), (3, "http://a.de/x", "<html lang='de'><p>und der die")], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.lang for r in langid.identify(pages, model).collect()}
    assert got[3] == "de" and set(got) == {1, 2, 3} and None not in got.values()
    assert langid.identify(pages.limit(0), model).count() == 0
    assert langid.identify(pages, langid.fit(empty)).filter("lang is not null").count() == 0


# -- 7 ----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="sidebar-left">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<article><h1>Title &amp; more</h1><p>One  two&nbsp;<b>three</b>
four.<p>Caf&eacute; &#8364; &lt;tag&gt;</p><div class="ad">Buy!</div><ul><li>first</li><li>second</li></ul><form><p>mail</p></form>
<section id="comments"><article><p>A reader says</p></article></section><p>Last</p></article>
<aside>Side</aside><footer><p>&copy; us</p></footer></body>"""


def test_page_text(spark):
    df = spark.createDataFrame([(1, "http://a.b/x", PAGE), (2, None, None), (3, "http://a.b/y", ""), (4, "http://a.b/z", "plain <i>text</i> only"), (4, "http://a.b/z", "plain <i>text</i> only")], "page_id bigint, url string, html string").withColumn("host_", F.lit("clash"))
    got = {r.page_id: r for r in pagediff.extract(df).collect()}
    assert got[1].text == "Title & more\nOne two three four.\nCafé € <tag>\nfirst\nsecond\nLast"
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0 and got[4].text == "plain text only"
    assert pagediff.extract(df).count() == 5 and pagediff.extract(df.limit(0)).count() == 0


def test_shared_lines_of_neighbours_go(spark):
    page = lambda k: f"<body><div>Welcome to the site</div><div>Story number {k} tells of {'many ' * k}things that happened long ago</div><div>All rights kept</div></body>"
    rows = [(k, f"http://site.example/{k:03}", page(k)) for k in range(1, 9)] + [(50, "http://other.example/1", page(3))]
    whole = {r.page_id: r.text for r in pagediff.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    cut = {r.page_id: r.text for r in pagediff.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), rows_per_range=2).collect()}
    assert whole == cut and all(whole[k].startswith("Story number") and "\n" not in whole[k] for k in range(1, 9)) and whole[50].count("\n") == 2


def test_a_short_story_under_long_boilerplate(spark):
    nav = "<nav>" + "<p>menu entry of the site</p>" * 20 + "</nav>"
    page = lambda k, day: f"<body>{nav}<div>Welcome to the site of many stories, read by all</div><div>Story {k}: {'word ' * (4 + k)}</div><div>All rights are kept by the owners of this site</div><p>{day}</p></body>"
    rows = [(k, f"http://site.example/{k:03}", page(k, "")) for k in range(1, 7)] + [(k, f"http://copies.example/{k}", page(40, k)) for k in (11, 12)]
    got = {r.page_id: r.text for r in pagediff.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[k] == f"Story {k}: {'word ' * (4 + k)}".strip() for k in range(1, 7))
    assert all(got[k].startswith("Welcome") and "Story 40" in got[k] for k in (11, 12))  # copies keep their text


def test_text_outside_the_article_stays_unless_shared(spark):
    page = lambda k: f"<body><div>Welcome to the site</div><article><h2>Teaser {k}</h2></article><div>Body number {k} goes on after {'many ' * k}things</div><div>All rights kept</div></body>"
    rows = [(k, f"http://site.example/{k:03}", page(k)) for k in range(1, 6)]
    got = {r.page_id: r.text for r in pagediff.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: f"Teaser {k}\nBody number {k} goes on after {'many ' * k}things" for k in range(1, 6)}


def test_names_that_no_list_knows(spark):
    """Differencing decides where the markup says nothing: whole pages of blocks with made-up names, expected texts by row."""
    page = lambda k, text: f'<body><div class="zorp">Zorp of the house</div><div class="qux1"><p>Home</p><p>Contact</p></div><section class="blarg"><h1>{text}</h1><p>Body {k} of {text}</p></section><div class="fnord">Kept by Zorp</div></body>'
    rows = [(k, f"http://zorp.example/{k:02}", page(k, f"tale {k * k}")) for k in range(10, 30)]
    got = {r.page_id: (r.text, r.n_shared) for r in pagediff.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), rows_per_range=6).collect()}
    assert got == {k: (f"tale {k * k}\nBody {k} of tale {k * k}", 4) for k in range(10, 30)}


def test_runs_of_copies_are_compared_with_the_page_beside_them(spark):
    page = lambda k: f"<body><div>Welcome to the site</div><div>Story {k} tells of {'many ' * k}things that happened a very long time ago, and of all that came of them in the end, as far as is known</div></body>"
    rows = [(k, "http://site.example/a", page(5)) for k in range(5)] + [(k, "http://site.example/b", page(9)) for k in range(10, 14)]
    df = spark.createDataFrame(rows + [(20, None, page(5)), (21, None, page(5)), (22, "http://alone.example/", page(5))], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pagediff.extract(df).collect()}
    assert all(got[k].startswith("Story") for k, *_ in rows) and all(got[k].startswith("Welcome") for k in (20, 21, 22))


def test_deep_and_long_pages():
    deep = "<div>" * 50_000 + "core" + "</p></div>" * 50_000
    assert [b.text for b in pagediff.blocks(deep)] == ["core"]
    assert len(pagediff.blocks("<p>x</p>" * 100_000)) == 100_000


def test_common_lines_are_a_longest_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert len(pagediff.common(a, b)) == row[-1]


def _next(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
    return new


def test_articles_of_the_table(spark):
    docs = {" ".join((r.text or "").split()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()}
    pages = queries()["op7_page_text"](spark, SF).collect()
    all_docs = {" ".join(x[0].split()) for x in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet'").fetchall()} | docs
    bodies = [" ".join(" ".join(r.text.split("\n")[1:]).split()) for r in pages]
    assert sum(b in all_docs for b in bodies) > 0.2 * len(bodies) and all(r.n_chars == len(r.text) for r in pages)


# -- 9 ----------------------------------------------------------------------------------


def test_fingerprints(spark, odd):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.dropDuplicates(["doc_id"]).collect()), reverse=True)
    got = {r.doc_id: r for r in cdc.edits(odd.dropDuplicates(["doc_id"]), rows_per_range=2).collect()}
    assert got.keys() == {r[0] for r in rows}
    for k, (doc, text) in enumerate(rows):
        follows = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        changed = text[: len(text) - cut] + follows[:cut]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == cdc.spelled(cdc.fingerprint(text.encode())) and r.edited_fingerprint == cdc.spelled(cdc.fingerprint(changed.encode()))
        assert 0 <= r.near_edited <= 1 and r.near_next == cdc.likeness(cdc.fingerprint(text.encode()), cdc.fingerprint(follows.encode()))
    assert cdc.edits(odd).count() == odd.count() and cdc.edits(odd.limit(0)).count() == 0


def boundaries_by_byte(data, rule=cdc.Chunking()):
    """The ends of chunks, byte by byte from the definition."""
    ends, start = [], 0
    for at in range(1, len(data) + 1):
        h = sum(int(cdc.GEAR[data[at - 1 - k]]) << k for k in range(min(at, cdc.WINDOW))) % (1 << cdc.WINDOW)
        size = at - start
        bits = rule.strict_bits if size < rule.wanted else rule.loose_bits
        if at == len(data) or size == rule.greatest or size >= rule.least and h >> (cdc.WINDOW - bits) == 0:
            ends.append(at)
            start = at
    return ends


def test_boundaries_equal_a_scan_by_bytes():
    for k in range(60):
        text = " ".join(random_words(1 + 7 * k, k))
        for data in (text.encode(), ("é" * k + text).encode(), b"a" * (3 * k)):
            assert cdc.boundaries(data) == boundaries_by_byte(data)


def test_equal_chunks_have_equal_entries():
    rng = random.Random(5)
    for _ in range(30):
        data = bytes(rng.choice(b"abc ") for _ in range(rng.randrange(600)))
        ends = cdc.boundaries(data)
        assert len(cdc.fingerprint(data)) == len({data[a:b] for a, b in zip([0, *ends], ends, strict=False)})


def test_chunks_resist_shifts_and_measure_containment():
    text = " ".join(random_words(3000, 1)).encode()
    assert b"".join(text[a:b] for a, b in zip([0, *cdc.boundaries(text)], cdc.boundaries(text), strict=False)) == text
    rule, sizes = cdc.Chunking(), np.diff([0, *cdc.boundaries(text)])
    assert sizes[:-1].min() >= rule.least and sizes.max() <= rule.greatest
    own = cdc.fingerprint(text)
    assert cdc.likeness(own, cdc.fingerprint(b"inserted " + text)) > 0.98
    assert cdc.likeness(own, cdc.fingerprint(text[: len(text) // 2])) > 0.97
    unlike = "".join(random.Random(3).choices("abcdefghij klmnop", k=20_000)).encode()
    assert cdc.likeness(own, cdc.fingerprint(unlike)) < 0.05
    assert (cdc.parsed(cdc.spelled(own)) == own).all()


def test_likeness_of_a_part_does_not_jump_at_any_length():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnop   ", k=4000)).encode() for _ in range(30)]
    means = []
    for n in [*range(200, 3000, 100), 1023, 1024, 1025, 1536]:
        means.append(np.mean([cdc.likeness(cdc.fingerprint(t[:n]), cdc.fingerprint(t[: 2 * n // 3])) for t in texts]))
        assert cdc.likeness(cdc.fingerprint(texts[0][:n]), cdc.fingerprint(texts[1])) < 0.02
    assert min(means) > 0.9
    middle = [np.mean([cdc.likeness(cdc.fingerprint(t[400 : 400 + n]), cdc.fingerprint(t)) for t in texts]) for n in (300, 900, 1100, 2000)]
    assert min(middle) > 0.85


def test_fingerprints_of_extreme_ids(spark):
    rows = [(-(1 << 63), "the least id"), ((1 << 63) - 1, "the greatest id"), (0, "in the middle of them"), (None, "without an id")]
    got = {r.doc_id: r.near_next for r in cdc.edits(spark.createDataFrame(rows, "doc_id bigint, text string"), rows_per_range=1).collect()}
    text = dict(rows)
    for doc, follows in (((1 << 63) - 1, 0), (0, -(1 << 63)), (-(1 << 63), None), (None, (1 << 63) - 1)):
        assert got[doc] == cdc.likeness(*(cdc.fingerprint(text[x].encode()) for x in (doc, follows)))
    with pytest.raises(TypeError):
        cdc.edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# -- 10 ---------------------------------------------------------------------------------


def test_exact_dedup(spark, odd, empty):
    groups = defaultdict(list)
    for r in odd.collect():
        groups["".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r")].append((-len(r.text or ""), r.doc_id))
    got = dedup.dedup(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.keep_id == min(groups[key])[1] and r.group_size == len(groups[key]) and r.kept == (r.doc_id == r.keep_id)
    kept = dedup.without_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert dedup.dedup(empty).count() == 0 and dedup.without_copies(empty).count() == 0
    nameless = spark.createDataFrame([(None, "a b c", "en", "s", 5), (1, "ab c", "en", "s", 4), (2, "abc", "en", "s", 3)], DOC_SCHEMA)
    assert {(r.doc_id, r.keep_id, r.kept) for r in dedup.dedup(nameless).collect()} == {(None, None, True), (1, None, False), (2, None, False)}


def test_bytes_of_many_words_are_spelled_in_one_step(library):
    coder = bpe.coder(tokenizer_path(), bpe.LibraryBpe)
    words = ["plain", "\u00e9t\u00e9", "\u4e2d\u6587", "a\x00b", "\U0001f600", "\x7f", "\u00a0x"]
    spelled = "".join(chr(32) + "".join(bpe.byte_symbols()[b] for b in w.encode()) for w in words)[1:]
    assert coder._all_symbols(" ".join(words)) == spelled
    texts = [" ".join(words[:k]) + "," * k for k in range(8)]
    for kind in (bpe.WordBpe, bpe.LibraryBpe):
        ids = bpe.coder(tokenizer_path(), kind).encode_block(pa.array(texts)).lists().to_pylist()
        assert ids == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_library_gets_each_word_of_a_block_once(library):
    coder, got = bpe.LibraryBpe(tokenizer_path()), []

    class Counted:
        def encode_batch_fast(self, texts, **named):
            got.extend(texts[0].split(" "))
            return real.encode_batch_fast(texts, **named)

    real, coder.library = coder.library, Counted()
    texts = ["plain plain, (plain) plain's", "it's 2,2 , 's plain. \u00e9t\u00e9 \u00e9t\u00e9!", "", "plain\x1cplain \u0661\u0661 \u00aa\u00b2 ,,"]
    for _ in range(2):
        ids = coder.encode_block(pa.array(texts)).lists().to_pylist()
        assert ids == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(got) == len({*got}) and "plain" in got  # the second time all pieces are known
    coder.clear()
    assert not len(coder._known) and not len(coder._flat)


def test_small_batches_are_encoded_together():
    batches = [pa.RecordBatch.from_pydict({"k": [2 * k, 2 * k + 1], "t": ["a" * 50, None if k == 3 else "b" * 50]}) for k in range(10)]
    got = list(bpe.gathered(iter([batches[0].slice(0, 0), *batches]), 400))
    assert [k for b in got for k in b.column(0).to_pylist()] == list(range(20)) and 1 < len(got) < 6
    assert pa.Table.from_batches(got).to_pylist() == pa.Table.from_batches(batches).to_pylist()
    assert list(bpe.gathered(iter([]))) == [] and len(list(bpe.gathered(iter(batches), 1))) == 10
