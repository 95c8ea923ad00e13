"""The registered queries: each operator over the driver's tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.functions import similarity as S
from linkspark.functions.lexicons import LEGAL_FORMS
from linkspark.functions.text import strip_accents, without_ocr_swaps, without_repeats
from linkspark.operators import decide as D
from linkspark.operators import metrics as M
from linkspark.operators.context import with_context
from linkspark.operators.group import by_record, group_features
from linkspark.operators.keys import char_keys, tokens, word_keys
from linkspark.operators.lists import compared
from linkspark.operators.pairs import each_pair, equal_rows, pairs_of_equals, pairs_of_scores, set_features, with_imputed_states
from linkspark.operators.retrieve import BLOCKS, SCALE, Depth, candidates, ranked
from linkspark.operators.split import fold_of, without_frequent_ids
from linkspark.operators.tfidf import weighted
from linkspark.sources.adapters import document_records, document_truth, party_records, table
from linkspark.sources.tables import id_lists, profile, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- documents as records ---------------------------------------------------------------

#: A key of more records than this is of no use to blocking; it bounds what a key can fan out to.
MAX_DF = 60
#: The operator's own bound, which the `_deep` queries have.
DEEP_MAX_DF = Depth().max_df_word
_max_df: ContextVar[int] = ContextVar("max_df", default=MAX_DF)
COSINE_SCALE = 6

RECORDS = """records AS (
  SELECT lang AS part, CASE WHEN CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 3 = 0 THEN 1 ELSE 2 END AS side,
         'S' || (CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 3 + 1) AS src, doc_id AS rid, text,
         list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS words
  FROM documents)"""
WEIGHTS = f"""{RECORDS},
keys AS (SELECT part, side, rid, unnest(words) AS key FROM records),
sizes AS (SELECT part, count(*) AS n FROM records GROUP BY part),
df AS (SELECT part, key, count(*) AS df FROM keys GROUP BY part, key HAVING count(*) BETWEEN 2 AND {MAX_DF} AND min(side) <> max(side)),
raw AS (SELECT k.part, k.side, k.rid, k.key, ln(CAST(n AS DOUBLE) / df) AS w FROM keys k JOIN df USING (part, key) JOIN sizes USING (part)),
weights AS (SELECT part, side, rid, key, w / sqrt(sum(w * w) OVER (PARTITION BY part, side, rid)) AS w FROM raw)"""
PAIRS = f"""{WEIGHTS},
pairs AS (SELECT a.part, a.rid AS a, b.rid AS b, round(sum(a.w * b.w), {COSINE_SCALE}) AS cos
          FROM weights a JOIN weights b ON a.part = b.part AND a.key = b.key AND a.side = 1 AND b.side = 2 GROUP BY ALL)"""
MATCHED = f"""{PAIRS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY part, a ORDER BY cos DESC, b) AS r FROM pairs),
owned AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY cos DESC, a) AS o FROM ranked WHERE r <= 5),
best AS (SELECT part, a AS s1, b AS eid, cos AS p FROM owned WHERE o = 1)"""


def document_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = document_records(spark, sf_dir)
    keys = records.select("part", "side", "rid", F.lit("w").alias("ns"), F.explode("words").alias("key"))
    return weighted(keys, records.groupBy("part").agg(F.count(F.lit(1)).alias("n_records")), {"w": 1.0}, max_df=_max_df.get())


def document_pairs(spark: SparkSession, sf_dir: str, top: int | None = None) -> DataFrame:
    """All pairs; with top, each a's best ones at least. Frequent words meet in blocks, rare ones by a join."""
    if _max_df.get() > MAX_DF:
        return compared(document_records(spark, sf_dir), _max_df.get(), top=top, digits=COSINE_SCALE)
    w = document_weights(spark, sf_dir)
    a = w.filter("side = 1").select("part", "key", F.col("rid").alias("a"), F.col("w").alias("wa"))
    b = w.filter("side = 2").select("part", "key", F.col("rid").alias("b"), F.col("w").alias("wb"))
    return a.join(b, ["part", "key"]).groupBy("part", "a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), COSINE_SCALE).alias("cos"))


def document_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = document_pairs(spark, sf_dir, 5).withColumn("r", ranked(F.col("cos"))).filter("r <= 5")
    return D.one_to_one(top.select("part", F.col("a").alias("s1"), F.col("b").alias("eid"), F.col("cos").alias("p")))


@query(
    f"""WITH {MATCHED},
truth AS (SELECT x.part, x.rid AS s1, y.rid AS eid FROM records x JOIN records y ON x.part = y.part AND x.text = y.text AND x.side = 1 AND y.side = 2),
kept AS (SELECT * FROM best WHERE p >= 0.8),
t AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY s1), q AS (SELECT s1, count(*) AS n_pred FROM kept GROUP BY s1),
h AS (SELECT k.s1, count(*) AS tp FROM kept k JOIN truth USING (s1, eid) GROUP BY k.s1),
e AS (SELECT r.part, coalesce(n_true, 0) AS nt, coalesce(n_pred, 0) AS np, coalesce(tp, 0) AS tp
      FROM records r LEFT JOIN t ON r.rid = t.s1 LEFT JOIN q ON r.rid = q.s1 LEFT JOIN h ON r.rid = h.s1 WHERE side = 1)
SELECT part, count(*) AS n_entities, round(avg(CASE WHEN nt = 0 AND np = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * nt + np) END), 6) AS macro_f05,
       CAST(sum(nt) AS BIGINT) AS n_true, CAST(sum(np) AS BIGINT) AS n_pred, CAST(sum(tp) AS BIGINT) AS tp FROM e GROUP BY part"""
)
def er_tfidf_topk_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF, key join, top 5, one owner a record, threshold, F0.5 by language."""
    records = document_records(spark, sf_dir)
    kept = D.apply_thresholds(document_best(spark, sf_dir).withColumn("src", F.lit("S2")), {}, 0.8)
    scores = M.entity_scores(records.filter("side = 1").select("part", F.col("rid").alias("s1")), document_truth(records), kept)
    return scores.groupBy("part").agg(F.count(F.lit(1)).alias("n_entities"), F.round(F.avg("f05"), 6).alias("macro_f05"), F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp"))


@query(f"WITH {WEIGHTS} SELECT part, side, rid, key, round(w, 6) AS w FROM weights")
def block_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_weights(spark, sf_dir).select("part", "side", "rid", "key", F.round("w", 6).alias("w"))


@query(f"WITH {PAIRS} SELECT part, count(*) AS n_pairs, round(sum(cos), 2) AS sum_cos, max(cos) AS max_cos FROM pairs GROUP BY part")
def block_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    if _max_df.get() > MAX_DF:
        totals = compared(document_records(spark, sf_dir), _max_df.get(), "totals", digits=COSINE_SCALE)
        return totals.groupBy("part").agg(F.sum("n_pairs").alias("n_pairs"), F.round(F.sum("sum_cos"), 2).alias("sum_cos"), F.max("max_cos").alias("max_cos"))
    return document_pairs(spark, sf_dir).groupBy("part").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.sum("cos"), 2).alias("sum_cos"), F.max("cos").alias("max_cos"))


@query(f"WITH {PAIRS} SELECT part, a, b, cos, r AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY part, a ORDER BY cos DESC, b) AS INT) AS r FROM pairs) WHERE r <= 5")
def topk_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pairs(spark, sf_dir, 5).withColumn("rank", ranked(F.col("cos"))).filter("rank <= 5")


@query(f"WITH {MATCHED} SELECT part, s1, eid, p FROM best")
def dec_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_best(spark, sf_dir)


@query(
    f"""WITH {MATCHED}, f AS (SELECT *, least(p, 0.999999) AS q FROM best WHERE p >= 0.05),
g AS (SELECT *, sum(q) OVER (PARTITION BY s1 ORDER BY q DESC, eid ROWS UNBOUNDED PRECEDING) AS cs, row_number() OVER (PARTITION BY s1 ORDER BY q DESC, eid) AS k,
             sum(q) OVER (PARTITION BY s1) AS tot, exp(sum(ln(1 - q)) OVER (PARTITION BY s1)) AS p0 FROM f),
e AS (SELECT *, round(1.25 * cs / (0.25 * tot + k), 12) AS ef FROM g),
m AS (SELECT *, max(ef) OVER (PARTITION BY s1) AS top FROM e),
s AS (SELECT *, min(CASE WHEN ef = top THEN k END) OVER (PARTITION BY s1) AS stop FROM m)
SELECT part, s1, eid, p FROM s WHERE top > p0 AND k <= stop"""
)
def dec_expected_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.expected_f(document_best(spark, sf_dir))


@query(f"WITH {MATCHED}, r AS (SELECT b.*, src FROM best b JOIN records ON rid = eid) SELECT part, s1, eid, p, src FROM r WHERE p >= CASE src WHEN 'S2' THEN 0.3 WHEN 'S3' THEN 0.6 ELSE 0.5 END")
def dec_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = document_records(spark, sf_dir).select(F.col("rid").alias("eid"), "src")
    return D.apply_thresholds(document_best(spark, sf_dir).join(src, "eid"), {"S2": 0.3, "S3": 0.6}).select("part", "s1", "eid", "p", "src")


KNOTS = {"x": [0.0, 0.2, 0.5, 0.9, 1.0], "y": [0.0, 0.05, 0.4, 0.95, 0.99]}


@query(
    f"""WITH {MATCHED} SELECT part, s1, eid, round(CASE WHEN p >= 1 THEN 0.99 WHEN p >= 0.9 THEN 0.95 + (p - 0.9) * 0.04 / 0.1 WHEN p >= 0.5 THEN 0.4 + (p - 0.5) * 0.55 / 0.4
 WHEN p >= 0.2 THEN 0.05 + (p - 0.2) * 0.35 / 0.3 ELSE p * 0.05 / 0.2 END, 8) AS q FROM best"""
)
def dec_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_best(spark, sf_dir).select("part", "s1", "eid", F.round(D.calibrated(F.col("p"), KNOTS), 8).alias("q"))


@query()
def dec_exact_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = document_best(spark, sf_dir).withColumn("q", D.calibrated(F.col("p"), KNOTS, 1.5))
    return D.exact_f(best, lam=0.05)


@query()
def dec_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = document_records(spark, sf_dir)
    best = document_best(spark, sf_dir)
    y = document_truth(records).select("s1", "eid").withColumn("y", F.lit(1))
    scored = stored(best.join(y, ["s1", "eid"], "left").na.fill(0, ["y"]), "scored")  # read three times
    return scored.withColumn("q", D.calibrated(F.col("p"), D.fit_isotonic(scored, n_knots=50)))


@query()
def dec_tuned_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = document_records(spark, sf_dir)
    best = stored(document_best(spark, sf_dir).join(records.select(F.col("rid").alias("eid"), "src"), "eid"), "best")
    entities = records.filter("side = 1").select(F.col("rid").alias("s1"))
    rule, f = D.tune_thresholds(best, entities, document_truth(records), ["S2", "S3"])
    return D.apply_thresholds(best, rule).select("s1", "eid", "p", "src")


@query(
    f"""WITH {MATCHED},
truth AS (SELECT x.rid AS s1, y.rid AS eid FROM records x JOIN records y ON x.part = y.part AND x.text = y.text AND x.side = 1 AND y.side = 2)
SELECT count(*) AS n_true, count(b.eid) AS n_found, round(count(b.eid) / CAST(count(*) AS DOUBLE), 6) AS recall FROM truth t LEFT JOIN best b USING (s1, eid)"""
)
def block_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkspark.operators.retrieve import blocking_recall

    found = document_best(spark, sf_dir).select(F.col("s1").alias("a"), F.col("eid").alias("b"))
    return blocking_recall(found, document_truth(document_records(spark, sf_dir))).select("n_true", "n_found", F.round("recall", 6).alias("recall"))


@query(
    f"""WITH {MATCHED}, s AS (SELECT DISTINCT rid AS s1 FROM records WHERE side = 1)
SELECT s.s1 AS source1_entity_id, coalesce(string_agg(CAST(eid AS VARCHAR), ',' ORDER BY p DESC, eid), '') AS matched_entity_ids FROM s LEFT JOIN best USING (s1) GROUP BY s.s1"""
)
def sink_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = document_records(spark, sf_dir).filter("side = 1").select(F.col("rid").alias("s1"))
    return id_lists(entities, document_best(spark, sf_dir), "p", "matched_entity_ids", descending=True)


@query(
    f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY part, b ORDER BY cos DESC, a) AS r FROM pairs)
SELECT part, b, count(*) AS n_s1_j, coalesce(max(CASE WHEN r = 1 THEN cos END), 0.0) AS first_j, coalesce(max(CASE WHEN r = 2 THEN cos END), 0.0) AS second_j,
       count(*) FILTER (cos >= 0.6) AS n_addr_hi_j FROM r GROUP BY part, b"""
)
def group_by_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cos")
    pairs = document_pairs(spark, sf_dir).select("part", "a", "b", c.alias("p1"), c.alias("cos_addr"), c.alias("cos_name"))
    return by_record(pairs).select("part", "b", "n_s1_j", "first_j", "second_j", "n_addr_hi_j")


@query(
    f"""WITH {PAIRS}, x AS (SELECT p.*, CASE WHEN src = 'S2' THEN 1 ELSE 0 END AS is_s2, row_number() OVER (PARTITION BY p.part, a ORDER BY cos DESC, b) AS rank FROM pairs p JOIN records ON rid = b),
j AS (SELECT *, row_number() OVER (PARTITION BY part, b ORDER BY cos DESC, a) AS rj FROM x),
k AS (SELECT part, b, max(CASE WHEN rj = 1 THEN cos END) AS f, coalesce(max(CASE WHEN rj = 2 THEN cos END), 0.0) AS s FROM j GROUP BY part, b)
SELECT x.part, a, x.b, CAST(rank AS INT) AS p1_rank_s1, max(cos) OVER w AS p1_max_s1, max(cos) OVER w - cos AS p1_gap_s1, count(*) FILTER (cos > 0.5) OVER w AS p1_n50_s1,
  max(cos) OVER (PARTITION BY x.part, a, is_s2) AS p1_max_src_s1, CAST(row_number() OVER (PARTITION BY x.part, a, is_s2 ORDER BY cos DESC, rank, x.b) AS INT) AS p1_rank_src_s1,
  CASE WHEN cos >= f THEN 1 WHEN cos >= s THEN 2 ELSE 3 END AS p1_rank_j, cos - CASE WHEN cos >= f THEN s ELSE f END AS p1_margin_j,
  count(*) FILTER (cos > 0.5) OVER w - CASE WHEN cos > 0.5 THEN 1 ELSE 0 END AS n_conf_ha_hi
FROM x JOIN k ON x.part = k.part AND x.b = k.b WINDOW w AS (PARTITION BY x.part, a)"""
)
def group_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = document_records(spark, sf_dir).select(F.col("rid").alias("b"), (F.col("src") == "S2").cast("int").alias("is_s2"))
    c = F.col("cos")
    pairs = document_pairs(spark, sf_dir).join(src, "b").withColumns({"p1": c, "cos_addr": c, "cos_name": c, "rank": ranked(c), "hb": F.lit(""), "sib": F.lit(0), "has_ha": F.lit(True), "cc": F.lit(-1.0)})
    out = group_features(pairs)
    return out.select("part", "a", "b", "p1_rank_s1", "p1_max_s1", "p1_gap_s1", "p1_n50_s1", "p1_max_src_s1", "p1_rank_src_s1", "p1_rank_j", "p1_margin_j", "n_conf_ha_hi")


def shares_sql(weights: str) -> str:
    return f"""WITH {weights}, t AS (SELECT part, side, rid, sum(w) AS s, sqrt(sum(w * w)) AS n, count(*) AS nf FROM raw GROUP BY ALL),
p AS (SELECT a.part, a.rid AS a, b.rid AS b, sum(a.w * b.w) AS dot, sum(a.w) AS sa, sum(b.w) AS sb FROM raw a JOIN raw b ON a.part = b.part AND a.key = b.key AND a.side = 1 AND b.side = 2 GROUP BY ALL)
SELECT p.part, a, b, round(dot / (x.n * y.n), 6) AS cos, round(sa / x.s, 6) AS cont_ab, round(sb / y.s, 6) AS cont_ba, x.nf AS nf_a, y.nf AS nf_b
FROM p JOIN t x ON x.part = p.part AND x.side = 1 AND x.rid = a JOIN t y ON y.part = p.part AND y.side = 2 AND y.rid = b"""


@query(shares_sql(WEIGHTS.replace(f"BETWEEN 2 AND {MAX_DF} AND", ">= 2 AND")))
def feat_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With frequent words, whatever their number of records; only the `_deep` version has a bound."""
    most = _max_df.get()
    out = compared(document_records(spark, sf_dir), most if most > MAX_DF else None, "shares", digits=COSINE_SCALE)
    return out.select("part", "a", "b", "cos", "cont_ab", "cont_ba", "nf_a", "nf_b")


@query(
    """WITH d AS (SELECT lang AS part, CASE WHEN CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 3 = 0 THEN 1 ELSE 2 END AS side, doc_id AS rid, md5(text) AS n, source AS s FROM documents),
n AS (SELECT part, n, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 2) AS n2 FROM d GROUP BY ALL), s AS (SELECT part, side, s, count(*) AS c FROM d GROUP BY ALL)
SELECT d.part, d.side, d.rid, CASE WHEN d.side = 1 THEN n1 ELSE n2 END AS name_dup, CASE WHEN d.side = 1 THEN n2 ELSE n1 END AS name_other, c AS addr_dup
FROM d JOIN n ON n.part = d.part AND n.n = d.n JOIN s ON s.part = d.part AND s.side = d.side AND s.s = d.s"""
)
def ctx_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumns({"part": F.col("lang"), "rid": F.col("doc_id"), "n_cmp": F.md5("text"), "a_norm": F.col("source")})
    return with_context(d.withColumn("side", F.when(F.regexp_extract("source", r"(\d+)", 1).cast("int") % 3 == 0, 1).otherwise(2)))


@query(
    """WITH d AS (SELECT doc_id, source AS a_loc, CASE WHEN doc_id % 3 = 0 THEN '' ELSE CASE WHEN n_chars > 0 THEN 'known' ELSE lang END END AS st FROM documents),
seen AS (SELECT a_loc, st, count(*) AS n FROM d WHERE a_loc <> '' AND st <> '' GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY a_loc) AS tot, max(n) OVER (PARTITION BY a_loc) AS mx FROM seen),
g AS (SELECT a_loc, min(st) AS v FROM u WHERE n = mx AND tot >= 5 AND n >= 0.9 * tot GROUP BY a_loc)
SELECT doc_id, CASE WHEN st = '' THEN coalesce(v, '') ELSE st END AS a_state FROM d LEFT JOIN g USING (a_loc)"""
)
def feat_impute_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("n_chars") > 0, "known").otherwise(F.col("lang"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("part"), F.col("source").alias("a_loc"), state.alias("a_state"))
    return with_imputed_states(d).select("doc_id", "a_state")


# -- parties ----------------------------------------------------------------------------

PARTY_PAIRS = """x AS (SELECT c_custkey AS a, s_suppkey AS b, regexp_replace(regexp_extract(c_name, '(\\d+)', 1), '^0+(\\d)', '\\1') AS ha, regexp_replace(regexp_extract(s_name, '(\\d+)', 1), '^0+(\\d)', '\\1') AS hb
  FROM customer JOIN supplier ON c_nationkey = s_nationkey)"""


def party_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of customers (a) and of suppliers (b) of a nation and a name: (part, name_<x>, <x>s), the arrays holding the keys."""
    side = lambda name, x: table(spark, sf_dir, name).select(F.col(f"{x}_{'cust' if x == 'c' else 'supp'}key").alias("rid"), F.col(f"{x}_nationkey").alias("part"), F.col(f"{x}_name").alias("name"))
    return equal_rows(side("customer", "c"), "a", ("name",)), equal_rows(side("supplier", "s"), "b", ("name",))


def party_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer and a supplier of a nation by their names: (part, as, bs, ha, hb, name_a, name_b), the arrays holding the keys."""
    house = lambda c: F.regexp_replace(F.regexp_extract(c, r"(\d+)", 1), r"^0+(?=\d)", "")
    a, b = party_rows(spark, sf_dir)
    return pairs_of_equals(a.withColumn("ha", house("name_a")), b.withColumn("hb", house("name_b")))


@query(
    f"""WITH {PARTY_PAIRS} SELECT a, b, CASE WHEN ha = '' OR hb = '' THEN -1 WHEN ha = hb THEN 1 ELSE 0 END AS house_eq, greatest(-100000.0, least(100000.0, CAST(CAST(hb AS BIGINT) - CAST(ha AS BIGINT) AS DOUBLE))) AS house_delta,
 CASE WHEN CAST(hb AS BIGINT) - CAST(ha AS BIGINT) IN (1,2,3,4,5,7,9,11,13,21) THEN 1 ELSE 0 END AS house_delta_sib,
 CASE WHEN ha <> hb AND (hb = substr(ha, 2) OR hb = left(ha, length(ha) - 1) OR ha = substr(hb, 2) OR ha = left(hb, length(hb) - 1)) THEN 1 ELSE 0 END AS house_trunc,
 CASE WHEN ha = hb THEN 1 ELSE 0 END AS num_inter FROM x"""
)
def feat_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = party_pairs(spark, sf_dir)
    side = lambda k: lambda c: F.col(f"h{k}") if c in ("a_house", "a_nums") else F.lit("")
    wanted = ("house_eq", "house_delta", "house_delta_sib", "house_trunc", "num_inter")
    found = set_features(side("a"), side("b"))
    return each_pair(pairs, *[found[c].alias(c) for c in wanted]).drop("part")


@query("SELECT c_custkey AS a, s_suppkey AS b, round(100 * jaro_winkler_similarity(lower(c_name), lower(s_name)), 3) AS jw FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def feat_jw(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (rows.withColumn(f"name_{x}", F.lower(f"name_{x}")) for rows, x in zip(party_rows(spark, sf_dir), "ab", strict=True))
    return each_pair(pairs_of_scores(a, b, "name"), F.col("score").alias("jw")).drop("part")


@query()
def feat_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = S.scored(F.lower("name_a"), F.lower("name_b"), {"ratio": S.ratio, "partial": S.partial, "token_set": S.token_set, "token_sort": S.token_sort})
    return each_pair(party_pairs(spark, sf_dir), score.alias("s")).select("a", "b", "s.*")


@query(
    """WITH p AS (SELECT p_partkey, list_distinct(list_filter(string_split(p_name, ' '), lambda t: length(t) >= 2)) AS w FROM part)
SELECT p_partkey, 'w' AS ns, unnest(w) AS key FROM p UNION ALL
SELECT p_partkey, 'b', least(w[i], w[j]) || '_' || greatest(w[i], w[j]) FROM p, (VALUES (1,2),(1,3),(1,4),(2,3),(2,4),(3,4)) v(i, j) WHERE len(w) >= j UNION ALL
SELECT p_partkey, 'c', unnest(list_distinct(list_filter([replace(p_name, ' ', '')], lambda t: length(t) >= 4))) FROM part"""
)
def key_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = {c: F.lit("") for c in ("a_house", "a_street", "a_loc", "a_nums", "a_ids")}
    parts = table(spark, sf_dir, "part").withColumns({"n_core": F.col("p_name"), "n_full": F.col("p_name"), "n_cmp": F.replace(F.col("p_name"), F.lit(" "), F.lit(""))} | none)
    return word_keys(parts, ["p_partkey"])


@query(
    """WITH p AS (SELECT p_partkey, ' ' || p_name || ' ' AS s FROM part), g AS (SELECT p_partkey, substr(s, CAST(i AS INT), 3) AS key FROM p, range(1, 200) r(i) WHERE i <= length(s) - 2 AND length(s) > 4)
SELECT DISTINCT p_partkey, 'g' AS ns, key FROM g WHERE trim(key) <> ''"""
)
def key_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return char_keys(table(spark, sf_dir, "part").withColumn("n_core", F.col("p_name")), ["p_partkey"])


@query()
def block_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(party_records(spark, sf_dir).withColumn("is_native", F.lit(0)))


# -- text scalars -----------------------------------------------------------------------


@query("SELECT doc_id, length(lower(strip_accents(text))) AS n, md5(lower(strip_accents(text))) AS digest FROM documents")
def norm_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.lower(strip_accents(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(plain).cast("bigint").alias("n"), F.md5(plain).alias("digest"))


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\\d+'), lambda d: coalesce(nullif(ltrim(d, '0'), ''), '0')), ' ') AS numbers FROM documents")
def norm_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkspark.functions.address import number_runs

    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(number_runs(F.col("text")), " ").alias("numbers"))


@query(
    """WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(w, lambda x, i: i = 1 OR x <> w[i - 1]), ' ')) AS digest FROM t"""
)
def norm_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    df = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    return df.select("doc_id", F.md5(F.array_join(without_repeats(F.col("w")), " ")).alias("digest"))


_FORMS = ", ".join(f"'{x}'" for x in LEGAL_FORMS)


@query(
    rf"""WITH t AS (SELECT doc_id, unnest(list_distinct(string_split(lower(regexp_replace(text, '\s+', ' ', 'g')), ' '))) AS w FROM documents),
m AS (SELECT doc_id, w, regexp_matches(w, '^\d+$') OR regexp_matches(w, '^\d+(st|nd|rd|th|er|e|eme|ere)$') OR w IN ({_FORMS}) AS kept,
  CASE WHEN regexp_matches(w, '\d') AND regexp_matches(w, '[a-z]') THEN translate(w, '015834@$', 'olsbeaas') ELSE w END AS mixed FROM t WHERE w <> '')
SELECT doc_id, w, CASE WHEN kept THEN w ELSE regexp_replace(mixed, '^l([bcdfghjkmnpqrstvwxz])', 'i\1') END AS put_right FROM m"""
)
def norm_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").withColumn("t", F.lower(F.regexp_replace("text", r"\s+", " ")))
    return df.select("doc_id", F.explode(tokens("t", 1)).alias("w")).select("doc_id", "w", without_ocr_swaps(F.col("w")).alias("put_right"))


@query()
def norm_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkspark.functions.text import NAME_FIELDS, with_names

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return with_names(lines, "raw").select("doc_id", "line", *NAME_FIELDS)


@query()
def norm_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkspark.functions.address import ADDRESS_FIELDS, with_addresses

    lines = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "fr", "France").when(F.col("lang") == "en", "US").otherwise("India").alias("country"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return with_addresses(lines, "raw", "country").select("doc_id", "line", *ADDRESS_FIELDS)


# -- the relational core ----------------------------------------------------------------


@query("SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    df = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT a.l_orderkey, count(*) AS n_pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber GROUP BY a.l_orderkey")
def join_self_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("j"))
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k"))
    return a.join(b, "l_orderkey").filter("j <> k").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS n_disc, count(DISTINCT l_suppkey) AS n_supp, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY ALL")
def agg_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_disc"), F.count_distinct("l_suppkey").alias("n_supp"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"))


@query("WITH r AS (SELECT l_orderkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) SELECT l_orderkey, max(x) AS best, coalesce(max(CASE WHEN r = 2 THEN x END), 0.0) AS second FROM r GROUP BY l_orderkey")
def agg_second_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    df = table(spark, sf_dir, "lineitem").withColumn("r", r).filter("r <= 2")
    return df.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("best"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("l_extendedprice"))), F.lit(0.0)).alias("second"))


@query("WITH c AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS tot, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) AS r FROM c) SELECT o_custkey, v AS mode, n FROM w WHERE r = 1 AND tot >= 5 AND n >= 0.3 * tot")
def agg_mode_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    at = Window.partitionBy("o_custkey")
    c = c.withColumns({"total": F.sum("n").over(at), "r": F.row_number().over(at.orderBy(F.desc("n"), "mode"))})
    return c.filter((F.col("r") == 1) & (F.col("total") >= 5) & (F.col("n") >= 0.3 * F.col("total"))).select("o_custkey", "mode", "n")


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def agg_ordered_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("o"), "o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(items, lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("SELECT l_orderkey, round(exp(sum(ln(1 - l_discount))), 12) AS kept FROM lineitem GROUP BY l_orderkey")
def agg_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.exp(F.sum(F.ln(1 - F.col("l_discount")))), 12).alias("kept"))


@query("WITH q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM events), b AS (SELECT len(list_filter(e, lambda x: x <= value)) AS bin, value FROM events, q) SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(sum(value), 2) AS total FROM b GROUP BY bin")
def agg_quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    cuts = df.agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col("value")))
    return df.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER w AS INT) AS rank, round(sum(l_quantity) OVER w, 2) AS running, count(*) OVER (PARTITION BY l_orderkey) AS n, max(l_quantity) OVER (PARTITION BY l_orderkey) AS top, round(sum(l_quantity) OVER (PARTITION BY l_orderkey) - l_quantity, 2) AS others FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber ROWS UNBOUNDED PRECEDING)")
def win_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Window.partitionBy("l_orderkey")
    order = at.orderBy(F.desc("l_quantity"), "l_linenumber")
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("rank"), F.round(F.sum(q).over(order.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.count(F.lit(1)).over(at).alias("n"), F.max(q).over(at).alias("top"), F.round(F.sum(q).over(at) - q, 2).alias("others"))


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def topk_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.first_of(table(spark, sf_dir, "events"), ["event_type", "user_id"], F.desc("value"), "event_id").select("event_type", "user_id", "event_id")


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)")
def topk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the 100 largest orders."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT c_nationkey AS nk, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nk"), F.col("c_acctbal").alias("bal")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nk"), F.col("s_acctbal").alias("bal")))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 UNION SELECT p_partkey FROM part WHERE p_size > 40")
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("k")).union(table(spark, sf_dir, "part").filter("p_size > 40").select("p_partkey")).distinct()


@query(
    """WITH l AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS a, list(DISTINCT left(o_orderpriority, 1)) AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, len(a) AS n_a, len(b) AS n_b, len(list_distinct(list_concat(a, b))) AS n_union, len(list_intersect(a, b)) AS n_inter, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n_except FROM l"""
)
def set_list_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set(F.left("o_orderpriority", F.lit(1))).alias("b"))
    n = lambda c: F.size(c).cast("bigint")
    return df.select("o_custkey", n("a").alias("n_a"), n("b").alias("n_b"), n(F.array_union("a", "b")).alias("n_union"), n(F.array_intersect("a", "b")).alias("n_inter"), n(F.array_except("a", "b")).alias("n_except"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN value > 50 THEN 2 ELSE 0 END AS kind, coalesce(try_cast(event_type AS BIGINT), -1) AS code, least(greatest(value, 1.0), 90.0) AS clipped FROM events WHERE starts_with(event_type, 'c') OR regexp_matches(event_type, '^[e-p]')")
def proj_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    df = table(spark, sf_dir, "events").filter(t.startswith("c") | t.rlike("^[e-p]"))
    return df.select("event_id", F.when(t.isin("click", "view"), 1).when(v > 50, 2).otherwise(0).alias("kind"), F.coalesce(t.try_cast("bigint"), F.lit(-1)).cast("bigint").alias("code"), F.least(F.greatest(v, F.lit(1.0)), F.lit(90.0)).alias("clipped"))


@query("SELECT doc_id, CAST(((doc_id * 2654435761 + 7) % 1000003) % 2 AS INT) AS fold FROM documents")
def model_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fold_of(F.col("doc_id")).alias("fold"))


@query()
def model_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probability of document quality from lengths, by cross-fitted trees."""
    from linkspark.operators.model import FoldEnsemble

    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(text).alias("chars"), F.regexp_count(text, F.lit(r"\s+")).alias("gaps"), F.regexp_count(text, F.lit(r"[#$%&*!|]")).alias("marks"), F.regexp_count(text, F.lit(r"\d")).alias("digits"), F.regexp_count(text, F.lit("\n")).alias("lines"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    rows = docs.join(labels, "doc_id").withColumn("fold", fold_of(F.col("doc_id")))
    params = {"maxIter": 10, "stepSize": 0.2, "maxDepth": 3, "maxBins": 32, "seed": 42}
    return FoldEnsemble(("chars", "gaps", "marks", "digits", "lines"), params).fit(rows).predict(rows, "p", fold="fold").select("doc_id", "fold", "y", "p")


@query(
    """WITH l AS (SELECT o_custkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_orderkey, l_linenumber, l_partkey) AS ids FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey),
e AS (SELECT o_custkey, unnest(string_split(ids, ',')) AS eid, generate_subscripts(string_split(ids, ','), 1) AS pos FROM l), f AS (SELECT eid FROM e GROUP BY eid HAVING count(*) > 30)
SELECT l.o_custkey, coalesce(string_agg(e.eid, ',' ORDER BY e.pos) FILTER (e.eid NOT IN (SELECT eid FROM f)), '') AS ids FROM l LEFT JOIN e USING (o_custkey) GROUP BY l.o_custkey"""
)
def util_frequent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    items = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey")))
    lists = both.groupBy("o_custkey").agg(F.array_join(F.transform(items, lambda x: x["l_partkey"].cast("string")), ",").alias("ids"))
    return without_frequent_ids(lists, "ids", 30)


@query("SELECT lang, count(*) AS n_rows, count(*) FILTER (doc_id IS NULL) AS missing_doc_id, count(*) FILTER (text IS NULL OR text = '') AS missing_text, count(*) FILTER (source IS NULL OR source = '') AS missing_source, count(*) FILTER (n_chars IS NULL) AS missing_n_chars FROM documents GROUP BY lang")
def util_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(table(spark, sf_dir, "documents"), "lang")


@query("SELECT lang, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (source = 'src1') AS src1, count(*) FILTER (source NOT IN ('src0', 'src1')) AS others FROM documents GROUP BY lang")
def util_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(s == "src0").alias("src0"), F.count_if(s == "src1").alias("src1"), F.count_if(~s.isin("src0", "src1")).alias("others"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red') AND CAST(p_size AS VARCHAR) LIKE '%1%'")
def util_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.contains("p_name", F.lit("red")) & F.contains(F.col("p_size").cast("string"), F.lit("1"))).select("p_partkey", "p_name")


@query("SELECT a.vec_id AS a, max(a.label) AS label, round(sum(x * x), 3) AS sq FROM (SELECT vec_id, label, unnest(embedding) AS x FROM embeddings) a GROUP BY a.vec_id")
def vec_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    sq = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), "label", F.round(sq, 3).alias("sq"))


# -- documents at the operator's own depth ----------------------------------------------


def deep(name: str) -> Query:
    """The query with keys of up to DEEP_MAX_DF records; its SQL is the query's own at that depth."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = _max_df.set(DEEP_MAX_DF)
        try:
            return QUERIES[name](spark, sf_dir)
        finally:
            _max_df.reset(token)

    run.__name__ = f"{name}_deep"
    return run


#: Document linkage queries that drop frequent keys, and feat_idf, which does not but has such a version too.
CAPPED = "er_tfidf_topk_f05 block_tfidf block_cosine topk_per_entity block_recall dec_one_to_one dec_expected_f dec_thresholds dec_calibrate dec_exact_f dec_isotonic dec_tuned_thresholds sink_id_lists group_by_record group_windows feat_idf".split()
for _name in CAPPED:
    _sql = shares_sql(WEIGHTS) if _name == "feat_idf" else SQL.get(_name)
    query(_sql.replace(f"BETWEEN 2 AND {MAX_DF} AND", f"BETWEEN 2 AND {DEEP_MAX_DF} AND") if _sql else None)(deep(_name))
