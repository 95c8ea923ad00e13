"""Features of candidate pairs. -1 stands for unknown: a side is missing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.functions import similarity as S
from linkspark.functions.lexicons import SIBLING_OFFSETS
from linkspark.operators.keys import char_keys, word_keys
from linkspark.operators.tfidf import pair_stats, weighted
from linkspark.sources.tables import stored

#: (feature, column of both sides or (of a, of b), scorer)
STRING_FEATURES = (
    ("core_ratio", "n_core", S.ratio), ("core_tsort", "n_core", S.token_sort), ("core_tset", "n_core", S.token_set), ("core_partial", "n_core", S.partial), ("core_jw", "n_core", S.jaro_winkler),
    ("cmp_ratio", "n_cmp", S.ratio), ("cmp_partial", "n_cmp", S.partial), ("fc_ratio", "n_fc", S.ratio),
    ("full_ratio", "n_full", S.ratio), ("full_tset", "n_full", S.token_set), ("full_tsort", "n_full", S.token_sort),
    ("raw_ratio", "name_lc", S.ratio), ("raw_tset", "name_lc", S.token_set),
    ("addr_ratio", "a_norm", S.ratio), ("addr_tset", "a_norm", S.token_set), ("addr_tsort", "a_norm", S.token_sort),
    ("street_ratio", "a_street", S.ratio), ("street_tset", "a_street", S.token_set), ("loc_tset", "a_loc", S.token_set), ("loc_ratio", "a_loc", S.ratio), ("house_ratio", "a_house", S.ratio),
    ("cmp_fc_partial", ("n_cmp", "n_fc"), S.partial), ("fc_cmp_partial", ("n_fc", "n_cmp"), S.partial), ("core_alias_tset", ("n_core", "n_alias"), S.token_set),
)
BLOCK_FEATURES = ("cos_name", "cos_addr", "cos_char", "cheap", "rank", "n_cands")
IDF_FEATURES = tuple(f"{block}_{x}" for block, xs in (("name", ("cos", "cont_ab", "cont_ba", "nf_a", "nf_b")), ("addr", ("cos", "cont_ab", "cont_ba", "nf_a", "nf_b")), ("char", ("cos", "cont_ab", "cont_ba"))) for x in xs)
SET_FEATURES = ("house_in_b", "house_b_in_a", "house_eq", "num_inter", "num_a", "num_b", "num_b_extra", "ids_inter", "ids_conflict", "state_match", "loc_match", "ntok_a", "ntok_b", "legal_eq", "legal_empty_b", "first_tok_eq", "last_tok_eq", "house_delta", "house_delta_sib", "nums_sib", "nums_sib_any", "house_trunc")
RECORD_FEATURES = ("a_empty_b", "street_empty_b", "is_s2", "is_domain_b", "is_native_b", "has_alias_b", "len_a", "len_b", "acr_prefix", "acr_rest")
CORE_FEATURES = ("cc_jacc", "cc_disjoint", "cc_diff_idf")
FEATURES = (*[f[0] for f in STRING_FEATURES], *BLOCK_FEATURES, *IDF_FEATURES, *SET_FEATURES, *RECORD_FEATURES, *CORE_FEATURES)
RECORD_COLUMNS = ("name_lc", "n_core", "n_cmp", "n_full", "n_fc", "n_alias", "n_legal", "a_norm", "a_street", "a_loc", "a_house", "a_nums", "a_ids", "a_state", "a_empty", "is_domain", "is_native", "has_alias")


#: Ids that a row of equal records holds at most; shares that the first side's rows are dealt to.
MOST_IDS, SHARES = 512, 16
#: Names and ids of the second side that a name meets at once.
MOST_NAMES, MOST_MET = 4096, 1 << 16


def equal_rows(records: DataFrame, name: str, fields: Sequence[str], ident: str = "rid") -> DataFrame:
    """A row for the records of a part with the same fields, or for each MOST_IDS of them: part, <field>_<name>, and <name>s, their ids."""
    at = Window.partitionBy("part", *fields)
    df = records.withColumn("n_", F.floor((F.row_number().over(at.orderBy(ident)) - 1) / MOST_IDS))
    return df.groupBy("part", *fields, "n_").agg(F.collect_list(ident).alias(f"{name}s")).select("part", *[F.col(c).alias(f"{c}_{name}") for c in fields], f"{name}s")


def pairs_of_equals(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows of a part, of equal_rows named a and b: what depends on the fields alone is worked out once for each and
    goes to all pairs of their records by each_pair. Rows of the second side go to SHARES of the first one's, so that a
    part is not one task."""
    n = SHARES * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.withColumn("share_", F.pmod(F.xxhash64(*[c for c in left.columns if c != "as"], F.get("as", F.lit(0))), F.lit(SHARES)).cast("int"))
    right = right.withColumn("share_", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return left.repartition(min(n, 400), "part", "share_").join(right.repartition(min(n, 400), "part", "share_"), ["part", "share_"]).drop("share_")


def pairs_of_scores(left: DataFrame, right: DataFrame, name: str, digits: int = 3) -> DataFrame:
    """(part, as, bs, score) of all pairs of rows of a part, of equal_rows named a and b with the field name: a row for a name of the
    first side and what it meets at once of the second with the same score, Jaro-Winkler to digits, so that names without equals
    make few rows too. As in SQL it is of the names' bytes in UTF-8, 0 where either is empty and null where either is. Sides are dealt
    out as by pairs_of_equals."""
    n = min(SHARES * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 400)
    one = left.select("part", F.pmod(F.xxhash64(f"{name}_a", F.get("as", F.lit(0))), F.lit(SHARES)).cast("int").alias("share_"), F.lit(1).alias("side"), F.col(f"{name}_a").alias("name"), F.col("as").alias("ids"))
    two = right.select("part", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share_"), F.lit(2).alias("side"), F.col(f"{name}_b").alias("name"), F.col("bs").alias("ids"))
    dealt = one.union(two).filter(F.col("part").isNotNull()).repartition(n, "part", "share_").sortWithinPartitions("part", "share_", F.col("side").desc())
    fields = [("part", left.schema["part"].dataType), ("as", left.schema["as"].dataType), ("bs", right.schema["bs"].dataType), ("score", T.DoubleType())]
    return dealt.mapInArrow(lambda batches: _score_rows(batches, digits), T.StructType([T.StructField(*f) for f in fields]))


def _score_rows(batches: Iterator[pa.RecordBatch], digits: int) -> Iterator[pa.RecordBatch]:
    """batches: (part, share, side, name, ids), of each part and share side 2 before side 1."""
    at, held, known = None, [], None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        start = 0
        while start < len(keys):
            end = start + 1
            while end < len(keys) and keys[end] == keys[start]:
                end += 1
            if keys[start][:2] != at:
                at, held, known = keys[start][:2], [], None
            rows = batch.slice(start, end - start)
            if keys[start][2] == 2:
                held.append(rows)
            elif held:
                known = known or _known_names(pa.Table.from_batches(held))
                for names in known:
                    yield from _scores(rows, *names, digits)
            start = end


def _bytes(name: str | None) -> str:
    """A character for each byte."""
    return (name or "").encode().decode("latin-1")


def _known_names(table: pa.Table) -> list[tuple[S.JaroWinklers, np.ndarray, np.ndarray, pa.Array]]:
    """Of MOST_NAMES rows at most with about MOST_MET ids: their names, which are null, and their numbers of ids and ids."""
    names, ids = table.column("name").to_pylist(), table.column("ids").combine_chunks()
    counts = pa.compute.list_value_length(ids).to_numpy()
    out, start = [], 0
    while start < len(names):
        end = start + max(1, min(MOST_NAMES, int(np.searchsorted(np.cumsum(counts[start : start + MOST_NAMES]), MOST_MET, side="right"))))
        own = names[start:end]
        out.append((S.JaroWinklers(list(map(_bytes, own))), np.array([x is None for x in own]), counts[start:end], ids.slice(start, end - start)))
        start = end
    return out


def _scores(rows: pa.RecordBatch, known: S.JaroWinklers, none: np.ndarray, counts: np.ndarray, ids: pa.Array, digits: int) -> Iterator[pa.RecordBatch]:
    names, mine, scale, width = rows.column("name").to_pylist(), rows.column("ids"), 10**digits, len(counts)
    single, flat = bool((counts == 1).all()), ids.flatten()
    step = max(1, MOST_MET // int(counts.sum()))
    for start in range(0, len(names), step):
        own = names[start : start + step]
        key = np.floor(known.scores(list(map(_bytes, own))) * scale + 0.5).astype(np.int64)
        key[[x == "" for x in own]] = 0
        key[:, none] = -1
        key[[x is None for x in own]] = -1
        key = np.sort(key << 20 | np.arange(width), axis=1)  # by score, then place
        place, score = (key & ((1 << 20) - 1)).ravel(), (key >> 20).ravel()
        first = np.append(True, score[1:] != score[:-1])
        first[::width] = True
        first = np.flatnonzero(first)
        ends = np.arange(len(place) + 1) if single else np.append(0, np.cumsum(counts[place]))
        met = flat.take(pa.array(place)) if single else ids.take(pa.array(place)).flatten()
        found = score[first]
        arrays = [
            rows.column("part").take(pa.array(np.zeros(len(first), np.int64))),
            mine.take(pa.array(start + first // width)),
            pa.ListArray.from_arrays(pa.array(np.append(ends[first], ends[-1]).astype(np.int32)), met),
            pa.array(found / scale, mask=found < 0),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "as", "bs", "score"])


def each_pair(pairs: DataFrame, *found: str | Column) -> DataFrame:
    """(part, a, b, found...) for each two records of the rows' ids."""
    df = pairs.select("part", "as", "bs", *found)
    names = df.columns[3:]
    return df.select("part", F.explode("as").alias("a"), "bs", *names).select("part", "a", F.explode("bs").alias("b"), *names)


def prepared(records: DataFrame, name: str = "business_name") -> DataFrame:
    return records.withColumns({"name_lc": F.lower(F.coalesce(F.col(name), F.lit(""))), "n_fc": F.replace(F.col("n_full"), F.lit(" "), F.lit(""))})


def with_imputed_states(records: DataFrame, min_share: float = 0.9, min_support: int = 5) -> DataFrame:
    """An empty a_state is filled by the part's usual state of the locality, where it is usual enough; both sides count."""
    seen = records.filter((F.col("a_loc") != "") & (F.col("a_state") != "")).groupBy("part", "a_loc", "a_state").agg(F.count(F.lit(1)).alias("n"))
    at = Window.partitionBy("part", "a_loc")
    usual = seen.withColumns({"total": F.sum("n").over(at), "most": F.max("n").over(at)})
    usual = usual.filter((F.col("n") == F.col("most")) & (F.col("total") >= min_support) & (F.col("n") >= min_share * F.col("total"))).groupBy("part", "a_loc").agg(F.min("a_state").alias("usual_"))
    return records.join(usual, ["part", "a_loc"], "left").withColumn("a_state", F.when(F.col("a_state") == "", F.coalesce("usual_", F.lit(""))).otherwise(F.col("a_state"))).drop("usual_")


def _listed(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def _known(missing: Column, match: Column) -> Column:
    return F.when(missing, F.lit(-1)).when(match, F.lit(1)).otherwise(F.lit(0))


def set_features(a, b) -> dict[str, Column]:
    """a, b: functions from a field's name to a side's column."""
    whole = lambda c: c.try_cast("bigint")
    ha, hb, na, nb = a("a_house"), b("a_house"), _listed(a("a_nums")), _listed(b("a_nums"))
    xa, xb, la, lb = _listed(a("a_ids")), _listed(b("a_ids")), _listed(a("a_loc")), _listed(b("a_loc"))
    ta, tb = F.split(a("n_core"), " "), F.split(b("n_core"), " ")
    shared = lambda x, y: F.size(F.array_intersect(x, y))
    some = lambda x: F.size(x) > 0
    none = lambda x: F.size(x) == 0
    no_house = (ha == "") | (hb == "")
    delta = whole(hb) - whole(ha)
    shifted = lambda n, sign: F.array(*[(whole(n) + F.lit(sign * k)).cast("string") for k in SIBLING_OFFSETS])
    cut = lambda h: (F.substring(h, 2, 1 << 20), F.left(h, F.length(h) - 1))
    clipped = (ha != hb) & ((hb == cut(ha)[0]) | (hb == cut(ha)[1]) | (ha == cut(hb)[0]) | (ha == cut(hb)[1]))
    extra = F.array_except(nb, na)
    return {
        "house_in_b": _known((ha == "") | none(nb), F.array_contains(nb, ha)),
        "house_b_in_a": _known((hb == "") | none(na), F.array_contains(na, hb)),
        "house_eq": _known(no_house, ha == hb),
        "num_inter": shared(na, nb),
        "num_a": F.size(na),
        "num_b": F.size(nb),
        "num_b_extra": F.size(extra),
        "ids_inter": shared(xa, xb),
        "ids_conflict": (some(xa) & some(xb) & (shared(xa, xb) == 0)).cast("int"),
        "state_match": _known((a("a_state") == "") | (b("a_state") == ""), a("a_state") == b("a_state")),
        "loc_match": _known(none(la) | none(lb), shared(la, lb) > 0),
        "ntok_a": F.size(ta),
        "ntok_b": F.size(tb),
        "legal_eq": _known((a("n_legal") == "") | (b("n_legal") == ""), a("n_legal") == b("n_legal")),
        "legal_empty_b": (b("n_legal") == "").cast("int"),
        "first_tok_eq": (F.get(ta, F.lit(0)) == F.get(tb, F.lit(0))).cast("int"),
        "last_tok_eq": (F.try_element_at(ta, F.lit(-1)) == F.try_element_at(tb, F.lit(-1))).cast("int"),
        "house_delta": F.least(F.greatest(delta, F.lit(-100000)), F.lit(100000)).cast("double"),
        "house_delta_sib": _known(no_house, F.coalesce(delta.isin(list(SIBLING_OFFSETS)), F.lit(False))),
        "nums_sib": _known((ha == "") | none(nb), ~F.array_contains(nb, ha) & F.coalesce(shared(nb, shifted(ha, 1)) > 0, F.lit(False))),
        "nums_sib_any": _known(none(na) | none(nb), F.exists(extra, lambda x: shared(na, shifted(x, -1)) > 0)),
        "house_trunc": _known(no_house, clipped),
    }


def record_features(a, b, source: Column) -> dict[str, Column]:
    """acr_prefix: how much of a single glued name of b spells the initials of a; acr_rest is scored with the strings."""
    initials = F.array_join(F.transform(_listed(a("n_full")), lambda t: F.left(t, F.lit(1))), "")
    stem = b("n_cmp")
    single = ~F.contains(b("n_full"), F.lit(" ")) & (F.length(stem) >= 4)
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length(initials), F.length(stem)), F.lit(1))), lambda k: (F.substring(initials, F.lit(1), k) == F.substring(stem, F.lit(1), k)) & (F.length(initials) > 0))
    flag = lambda c: c.cast("int")
    return {
        "a_empty_b": flag(b("a_empty")),
        "street_empty_b": flag(b("a_street") == ""),
        "is_s2": flag(source == "S2"),
        "is_domain_b": flag(b("is_domain")),
        "is_native_b": flag(b("is_native")),
        "has_alias_b": flag(b("has_alias")),
        "len_a": F.length(a("n_core")),
        "len_b": F.length(b("n_core")),
        "acr_prefix": F.when(single, F.size(F.filter(same, lambda x: x))).otherwise(F.lit(-1)),
    }


def content_core(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Per pair (part, a, b, core_a, core_b, loc_a, loc_b): cc_jacc, cc_disjoint, cc_diff_idf of the core words that are
    not of either locality; a word's weight is ln(records / records with it), an unseen word's ln(records)."""
    words = lambda c: F.array_distinct(_listed(F.col(c)))
    ids = ["part", "a", "b"]
    sizes = records.groupBy("part").agg(F.count(F.lit(1)).alias("n_records"))
    idf = records.select("part", F.explode(words("n_core")).alias("word")).groupBy("part", "word").agg(F.count(F.lit(1)).alias("df"))
    places = F.array_union(words("loc_a"), words("loc_b"))
    df = pairs.select(*ids, F.array_except(words("core_a"), places).alias("ca"), F.array_except(words("core_b"), places).alias("cb"))
    df = df.withColumns({"u": F.array_union("ca", "cb"), "both": F.array_intersect("ca", "cb"), "empty": (F.size("ca") == 0) | (F.size("cb") == 0)})
    each = df.select(*ids, F.explode("u").alias("word"), "both").join(idf, ["part", "word"], "left").join(F.broadcast(sizes), "part")
    weight = F.ln("n_records") - F.ln(F.coalesce("df", F.lit(1)))
    sums = each.groupBy(*ids).agg(F.sum(weight).alias("su"), F.sum(F.when(F.array_contains("both", F.col("word")), 0.0).otherwise(weight)).alias("sd"))
    df = df.join(sums, ids, "left")
    unknown = lambda c: F.when(F.col("empty"), F.lit(-1.0)).otherwise(c)
    return df.select(
        *ids,
        unknown(F.size("both") / F.greatest(F.size("u"), F.lit(1))).alias("cc_jacc"),
        unknown((F.size("both") == 0).cast("double")).alias("cc_disjoint"),
        F.when(F.col("empty") | (F.coalesce("su", F.lit(0.0)) <= 0), F.lit(-1.0)).otherwise(F.try_divide("sd", "su")).alias("cc_diff_idf"),
    )


def with_core_weights(rows: DataFrame, records: DataFrame, name: str) -> DataFrame:
    """rows (part, n_core_<name>, ...) with core_<name>, the distinct core words and their weights as content_core has them."""
    core, sizes = F.array_distinct(_listed(F.col("n_core"))), records.groupBy("part").agg(F.count(F.lit(1)).alias("n_records"))
    counts = records.groupBy("part", "n_core").agg(F.count(F.lit(1)).alias("n")).withColumn("word", F.explode(core))
    idf = counts.groupBy("part", "word").agg(F.sum("n").alias("df")).join(F.broadcast(sizes), "part").select("part", "word", (F.ln("n_records") - F.ln("df")).alias("weight"))
    words = counts.select("part", "n_core", "word").join(idf, ["part", "word"]).groupBy("part", "n_core").agg(F.collect_list(F.struct("word", "weight")).alias(f"core_{name}"))
    none = F.array().cast(words.schema[f"core_{name}"].dataType)
    words = words.withColumnRenamed("n_core", f"n_core_{name}")
    return rows.join(words, ["part", f"n_core_{name}"], "left").withColumn(f"core_{name}", F.coalesce(f"core_{name}", none))


def core_features(core_a: Column, core_b: Column, loc_a: Column, loc_b: Column) -> dict[str, Column]:
    """CORE_FEATURES of a pair from its words with weights and the localities; nothing is dealt out by pair."""
    places = F.array_union(_listed(loc_a), _listed(loc_b))
    kept = lambda xs: F.filter(xs, lambda x: ~F.array_contains(places, x["word"]))
    a, b = kept(core_a), kept(core_b)
    union, both = F.array_union(a, b), F.array_intersect(a, b)
    weight = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x["weight"])
    empty, su = (F.size(a) == 0) | (F.size(b) == 0), weight(union)
    unknown = lambda c: F.when(empty, F.lit(-1.0)).otherwise(c)
    return {
        "cc_jacc": unknown(F.size(both) / F.greatest(F.size(union), F.lit(1))),
        "cc_disjoint": unknown((F.size(both) == 0).cast("double")),
        "cc_diff_idf": F.when(empty | (su <= 0), F.lit(-1.0)).otherwise(F.try_divide(weight(F.array_except(union, both)), su)),
    }


def idf_features(found: DataFrame, records: DataFrame) -> DataFrame:
    """Containment and cosine of raw weights over all shared keys, by block."""
    keep = ["part", "side", "rid"]
    sizes = records.groupBy("part").agg(F.count(F.lit(1)).alias("n_records"))
    ids = ["part", "a", "b"]
    out = found.select(*ids)
    # several joins read keys and weights: they are written, and graphs stay small
    words, chars = stored(word_keys(records, keep), "words"), stored(char_keys(records, keep), "chars")
    for block, keys, scale in (("name", words, {"w": 1.0}), ("addr", words, {"s": 1.0, "l": 1.0, "n": 1.0, "x": 1.0}), ("char", chars, {"g": 1.0})):
        stats = pair_stats(found, stored(weighted(keys, sizes, scale, max_df=1e12, min_df=1, normalise=False), block))
        wanted = [f for f in IDF_FEATURES if f.startswith(f"{block}_")]
        out = out.join(stats.select(*ids, *[F.col(f.split("_", 1)[1]).alias(f) for f in wanted]), ids)
    return out


def featurised(found: DataFrame, records: DataFrame, source: str = "src") -> DataFrame:
    """found: candidates (part, a, b, BLOCK_FEATURES); records: (part, side, rid, src, fields). Returns part, a, b and FEATURES."""
    records = stored(with_imputed_states(records), "records")
    side = lambda n, name: records.filter(F.col("side") == n).select("part", F.col("rid").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in RECORD_COLUMNS], F.col(source).alias(f"src_{name}"))
    ids = ["part", "a", "b"]
    df = found.join(side(1, "a"), ["part", "a"]).join(side(2, "b"), ["part", "b"])
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    df = df.withColumns(set_features(a, b) | record_features(a, b, F.col("src_b")))
    prefix = F.col("acr_prefix")
    df = df.withColumn("rest_", F.when(prefix >= 2, F.substring(F.col("n_cmp_b"), prefix + 1, F.lit(1 << 20))).when(prefix >= 0, F.col("n_cmp_b")))
    strings = [(n, F.col(f"{c if isinstance(c, str) else c[0]}_a"), F.col(f"{c if isinstance(c, str) else c[1]}_b"), f) for n, c, f in STRING_FEATURES]
    df = df.withColumn("strings_", S.all_scored([*strings, ("acr_rest", F.col("rest_"), F.col("n_fc_a"), S.partial)]))
    df = df.withColumn("strings_", F.when(F.col("rest_") == "", F.col("strings_").withField("acr_rest", F.lit(0.0))).otherwise(F.col("strings_")))
    core = content_core(df.select(*ids, F.col("n_core_a").alias("core_a"), F.col("n_core_b").alias("core_b"), F.col("a_loc_a").alias("loc_a"), F.col("a_loc_b").alias("loc_b")), records)
    df = df.select(*ids, *BLOCK_FEATURES, *SET_FEATURES, *[f for f in RECORD_FEATURES if f != "acr_rest"], "strings_.*")
    df = df.join(idf_features(found, records), ids).join(core, ids)
    return df.select(*ids, *FEATURES)
