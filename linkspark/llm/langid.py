"""Language identification of pages by Bayesian evidence fusion.

Naive Bayes over letter trigrams gives a page's text likelihood by language. To it come
the language that the markup declares, the suffix of the address, and a prior of the
host. How far declarations and suffixes can be trusted, and the priors, are counted over
all pages from the text's posteriors, in grouped aggregations; a host's prior is smoothed
towards that of its registered name, and that towards the whole corpus's.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.cascade import host_and_path
from linkspark.llm.common import mapped, share_below, stored

#: Labelled documents that a fit reads at most, about; all their trigrams count, and come to the driver with their sums.
MAX_FIT = 4000
#: Trigrams that count in full; of the others, which depend on them, this share.
FULL, REST = 60, 0.02
#: Pages that a smoothing prior counts as.
PRIOR = 5.0
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^>]*>", re.S | re.I)
#: A comment, or the html tag.
HTML = re.compile(r"<!--.*?(?:-->|\Z)|<html\b([^>]*)", re.S | re.I)
DECLARED = re.compile(r"""\blang\s*=\s*["']?([A-Za-z]+)""", re.I)
WORD = re.compile(r"[^\W\d_]+")
MAX_CACHED = 200_000


class TextModel(NamedTuple):
    languages: tuple[str, ...]
    grams: dict[str, int]
    weights: np.ndarray  # log likelihoods by gram (the last row: any other) and language


def word_grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[k : k + 3] for k in range(len(w) - 2)]


def declared_language(page: str) -> str:
    """Of the first html tag outside comments, wherever it is; "" without one."""
    tag = next((m[1] for m in HTML.finditer(page) if m[1] is not None), "")
    found = DECLARED.search(tag)
    return found[1].lower() if found else ""


def fit(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_fit: int = MAX_FIT) -> TextModel:
    """Trigram likelihoods from about max_fit labelled documents; rows without a label are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Counter(WORD.findall((text or "").lower()))
                own = counts.setdefault(lang, Counter())
                for w, n in words.items():
                    for g in word_grams(w):
                        own[g] += n
        for lang, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])

    known = documents.filter(F.col(lang_col).isNotNull())
    sample = known.filter(share_below(known, id_col, max_fit)).select(F.col(text_col), F.col(lang_col))
    counts = mapped(sample, run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counts.collect()
    languages = tuple(sorted({r.lang for r in rows}))
    grams = {g: k for k, g in enumerate(sorted({r.gram for r in rows}))}
    weights = np.full((len(grams) + 1, len(languages)), 0.5)
    for r in rows:
        weights[grams[r.gram], languages.index(r.lang)] += r.n
    return TextModel(languages, grams, np.log(weights / weights.sum(0)))


def evidence(pages: DataFrame, model: TextModel, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, host, declared, text (log likelihood by language, over tempered counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, int]] = {}
        grams, weights, other = model.grams, model.weights, len(model.grams)
        for batch in batches:
            declared, logs = [], []
            for k in range(batch.num_rows):
                page = batch.column(2)[k].as_py() or ""
                declared.append(declared_language(page))
                if len(known) > MAX_CACHED:
                    known.clear()
                total, n = np.zeros(len(model.languages)), 0
                for w, times in Counter(WORD.findall(html.unescape(MARKUP.sub(" ", page)).lower())).items():
                    if (one := known.get(w)) is None:
                        own = word_grams(w)
                        one = known[w] = (weights[[grams.get(g, other) for g in own]].sum(0), len(own))
                    total += times * one[0]
                    n += times * one[1]
                logs.append(total * ((min(n, FULL) + REST * max(0, n - FULL)) / n if n else 0.0))
            flat = pa.array(np.concatenate([*logs, np.zeros(0)]))
            ends = pa.array(np.arange(len(logs) + 1, dtype=np.int32) * len(model.languages))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(declared, pa.string()), pa.ListArray.from_arrays(ends, flat)], [id_col, "host", "declared", "text"])

    host, _ = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), F.col(html_col))
    return mapped(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, host string, declared string, text array<double>")


def identify(pages: DataFrame, model: TextModel, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, lang, p (posterior of lang), text_lang (by text alone), declared.

    Null or empty html has no text evidence; null or odd urls share the empty host.
    Without any evidence the corpus's most frequent language is given; equal posteriors
    go to the first code. Repeated rows stay. An empty table gives an empty one. With
    no labelled document there is no language: lang is null. Other columns are not
    looked at. Pages of any length are read whole; a page's words count tempered, so a
    long text does not drown the other evidence.
    """
    count = len(model.languages)
    seen = evidence(pages, model, id_col=id_col, url_col=url_col, html_col=html_col)
    if not count:
        return seen.select(id_col, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("string").alias("text_lang"), "declared")
    each = range(count)
    top = F.array_max("text")
    shares = F.transform("text", lambda x: F.exp(x - top))
    seen = seen.withColumn("q", shares)
    seen = seen.withColumn("q", F.transform("q", lambda x: x / F.aggregate("q", F.lit(0.0), lambda a, y: a + y)))
    seen = seen.withColumns({"suffix": F.substring_index("host", ".", -1), "name": F.substring_index("host", ".", -2)})
    seen = stored(seen, "evidence")
    sums = lambda: [F.sum(F.col("q")[k]).alias(f"s{k}") for k in each]
    whole = seen.agg(*sums()).first()
    total = np.array([whole[k] or 0.0 for k in each])
    corpus = (total + 1) / (total.sum() + count)

    def likelihoods(of: str, out: str) -> DataFrame:
        """Of each value of the evidence, by language, smoothed by the value's own share."""
        by = seen.groupBy(of).agg(*sums(), F.count(F.lit(1)).alias("n"))
        share = F.col("n") / F.lit(float(max(total.sum(), 1.0)))
        return by.select(F.col(of), F.array(*[F.ln((F.col(f"s{k}") + F.lit(PRIOR) * share) / F.lit(float(total[k] + PRIOR))) for k in each]).alias(out))

    names = seen.groupBy("name").agg(*sums(), F.count(F.lit(1)).alias("n"))
    names = names.select("name", F.array(*[(F.col(f"s{k}") + F.lit(float(PRIOR * corpus[k]))) / (F.col("n") + F.lit(PRIOR)) for k in each]).alias("of_name"))
    hosts = seen.groupBy("host", "name").agg(*sums(), F.count(F.lit(1)).alias("n"))
    hosts = hosts.join(names, "name").select("host", F.array(*[F.col(f"s{k}") for k in each]).alias("of_host"), F.col("n").alias("pages"), "of_name")
    out = seen.join(hosts, "host").join(likelihoods("declared", "by_declared"), "declared").join(likelihoods("suffix", "by_suffix"), "suffix")
    # a page does not count towards its own prior
    prior = lambda k: F.ln((F.greatest(F.col("of_host")[k] - F.col("q")[k], F.lit(0.0)) + F.lit(PRIOR) * F.col("of_name")[k]) / (F.col("pages") - 1 + F.lit(PRIOR)))
    fused = F.array(*[F.col("text")[k] + F.col("by_declared")[k] + F.col("by_suffix")[k] + prior(k) for k in each])
    out = out.withColumn("fused", fused).withColumn("best", F.array_max("fused"))
    code = F.array(*[F.lit(x) for x in model.languages])
    p = F.lit(1.0) / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    pick = lambda a, b: F.element_at(code, F.array_position(a, b).cast("int"))
    return out.select(id_col, pick(F.col("fused"), F.col("best")).alias("lang"), p.alias("p"), pick(F.col("q"), F.array_max("q")).alias("text_lang"), "declared")
