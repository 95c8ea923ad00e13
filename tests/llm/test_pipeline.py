from collections import Counter

import corpus_pipeline
from linkspark.llm import toxicity
from linkspark.llm.queries import tokenizer_path
from tokenizers import Tokenizer

from conftest import TINY

from .fixtures import near_groups, odd_documents


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").persist()
    labels = spark.read.parquet(f"{TINY}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "near dedup", "mixing", "bpe"]
    clean = stages["toxicity"](spark, docs, TINY).persist()
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).filter("reject").collect()}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad
    one = stages["exact dedup"](spark, clean, TINY).persist()
    first = {}
    for r in clean.collect():
        key = "".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r")
        first[key] = min(first.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in one.collect()) == sorted(v[1] for v in first.values())
    near = stages["near dedup"](spark, one, TINY).persist()
    groups = near_groups({r.doc_id: r.text for r in one.select("doc_id", "text").collect()})
    assert sorted(r.doc_id for r in near.collect()) == sorted({v for v in groups.values()})
    mixed = stages["mixing"](spark, near, TINY).persist()
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    wanted, got = (sum(len((r.text or "").split()) for r in df.collect()) for df in (near, mixed))
    assert abs(got - 1.5 * wanted) < 0.15 * wanted
    out = stages["bpe"](spark, mixed, TINY).collect()
    library = Tokenizer.from_file(tokenizer_path())
    text = {r.doc_id: r.text for r in near.collect()}
    assert len(out) == mixed.count() and all(r.ids == library.encode(text[r.doc_id] or "", add_special_tokens=False).ids for r in out)


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, TINY)
    rows = lambda df: sorted((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, TINY)) == rows(docs)


def test_stages_on_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    for docs in (odd, odd.limit(0)):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, TINY)
            assert name == "bpe" or docs.columns == names
        found = {r.doc_id for r in docs.collect()}
        assert found <= {r.doc_id for r in odd.collect()} and (not found or {7, 11, 13} & found)
