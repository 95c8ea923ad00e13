"""The linkage pipeline: prepare -> train -> predict, as one graph for all parts.

Every join and window has the part (country) in its key; only the tuning of rules goes part by part.
Stages are parquet tables under the work folder and are read again if they are there.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions.address import with_addresses
from linkspark.functions.text import has_non_latin, with_names
from linkspark.operators import decide as D
from linkspark.operators import rules as R
from linkspark.operators.context import CONTEXT_FEATURES, context_features
from linkspark.operators.group import GROUP_FEATURES, cluster_support, group_features
from linkspark.operators.keys import ADDRESS_WEIGHTS, NAME_WEIGHTS, word_keys
from linkspark.operators.metrics import entity_scores, report
from linkspark.operators.model import PARAMS, FoldEnsemble
from linkspark.operators.pairs import FEATURES, featurised, prepared
from linkspark.operators.retrieve import Depth, candidates
from linkspark.operators.split import fold_of, hash_share, learned_words
from linkspark.operators.tfidf import weighted
from linkspark.sources import tables as T

STAGE_ONE = (*FEATURES, *CONTEXT_FEATURES)
STAGE_TWO = (*STAGE_ONE, *GROUP_FEATURES)


@dataclass(frozen=True)
class Config:
    depth: Depth = Depth()
    n_folds: int = 2
    stage1_sample: float = 1.0  # of entities that each stage's models are fitted on
    stage2_sample: float = 1.0
    unlabelled_temperature: float = 1.5
    unlabelled_lam: float = 0.0
    bucket_offsets: dict = field(default_factory=dict)
    trees: dict = field(default_factory=lambda: dict(PARAMS))
    methods: tuple = ("thr", "ef", "exact")


def normalised(records: DataFrame, words: dict[str, str] | None = None, *, name: str = "business_name", address: str = "business_address", country: str = "country") -> DataFrame:
    """records (entity_id, src, name, address, country) with the canonical fields, as (part, side, rid, src, ...)."""
    df = with_addresses(with_names(records, name, words), address, country, words)
    side = F.when(F.col("src") == "S1", 1).otherwise(2)
    return prepared(df, name).withColumns({"part": F.col(country), "rid": F.col("entity_id"), "side": side})


def learn_dictionary(sources: dict[str, DataFrame], truth: DataFrame) -> dict[str, str]:
    """Native words of matched names, with their Latin partners. It is bounded by the vocabulary and fits the driver."""
    other = sources["S2"].unionByName(sources["S3"]).filter(has_non_latin(F.col("business_name"))).select(F.col("entity_id").alias("eid"), F.col("business_name").alias("native"))
    pairs = truth.join(other, "eid").join(sources["S1"].select(F.col("entity_id").alias("s1"), F.col("business_name").alias("latin")), "s1")
    return {r.native_word: r.word for r in learned_words(pairs, "latin", "native").collect()}


def labelled(found: DataFrame, truth: DataFrame) -> DataFrame:
    y = truth.select(F.col("s1").alias("a"), F.col("eid").alias("b")).distinct().withColumn("y", F.lit(1))
    return found.join(y, ["a", "b"], "left").na.fill(0, ["y"])


def grouped(scored: DataFrame, records: DataFrame) -> DataFrame:
    """Competition features of pairs that have p1, the pair features and the record fields."""
    b = records.filter("side = 2").select("part", F.col("rid").alias("b"), F.col("a_house").alias("hb"))
    pairs = scored.join(b, ["part", "b"]).withColumns({"sib": F.greatest(F.col("house_delta_sib"), F.lit(0)), "has_ha": F.col("house_in_b") == 1, "cc": F.col("cc_jacc")})
    right = records.filter("side = 2")
    keys = word_keys(right, ["part", "side", "rid"])
    sizes = records.groupBy("part").agg(F.count(F.lit(1)).alias("n_records"))
    both = keys.unionByName(keys.withColumn("side", F.lit(1)))  # similarity among records of one side
    vectors = {n: T.stored(weighted(both, sizes, w, max_df=1e12).filter("side = 2"), n) for n, w in (("name", {"w": NAME_WEIGHTS["w"]}), ("addr", {k: ADDRESS_WEIGHTS[k] for k in ("s", "l", "n", "x")}))}
    return group_features(pairs, cluster_support(pairs, vectors))


def weighted_mean(folds: Iterable[tuple[int, int, float]]) -> float:
    """Of (fold, entities, value): the mean over folds of the values weighted by entities."""
    by: dict[int, list[tuple[int, float]]] = {}
    for k, n, f in folds:
        by.setdefault(k, []).append((n, f))
    means = [sum(n * f for n, f in own) / max(sum(n for n, _ in own), 1) for own in by.values()]
    return sum(means) / max(len(means), 1)


@dataclass
class Linkage:
    """spark, the folder of a run's stages, and settings."""

    spark: SparkSession
    work: str
    config: Config = field(default_factory=Config)
    force: bool = False
    model: str = ""  # the folder of models and rules; empty: below work

    def sources(self, folder: str, split: str) -> dict[str, DataFrame]:
        return {f"S{k}": T.read_tsv(self.spark, f"{folder}/{split}_source{k}.tsv") for k in (1, 2, 3)}

    def _stage(self, name: str, make) -> DataFrame:
        return T.stage(self.spark, f"{self.work}/{name}", make, force=self.force)

    def prepare(self, split: str, sources: dict[str, DataFrame], words: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(normalised records, candidates)."""
        every = None
        for name, df in sources.items():
            df = df.withColumn("src", F.lit(name))
            every = df if every is None else every.unionByName(df)
        records = self._stage(f"norm/{split}", lambda: normalised(every, words))
        return records, self._stage(f"cands/{split}", lambda: candidates(records, self.config.depth))

    def features(self, split: str, records: DataFrame, found: DataFrame) -> DataFrame:
        return self._stage(f"features/{split}", lambda: context_features(featurised(found, records), records))

    @property
    def model_dir(self) -> str:
        return self.model or f"{self.work}/model"

    def train(self, records: DataFrame, found: DataFrame, truth: DataFrame, *, reuse_stage1: bool = False) -> dict:
        """Fits both stages and the decision; the artefacts come back and are saved in the model folder. With reuse_stage1
        the saved models of stage one stay, and so do its scores if they are there."""
        n = self.config.n_folds
        fold = fold_of(F.xxhash64("a"), n)
        base = labelled(self.features("train", records, found), truth).withColumn("fold", fold)
        sample = lambda rows, share, seed: rows if share >= 1 else rows.filter(hash_share(F.col("a"), share, seed))
        if reuse_stage1:
            one = FoldEnsemble.load(f"{self.model_dir}/stage1", STAGE_ONE)
        else:
            one = FoldEnsemble(STAGE_ONE, self.config.trees).fit(sample(base, self.config.stage1_sample, 1), n_folds=n)
        scored = self._stage("scores/train_p1", lambda: one.predict(base, "p1", fold="fold").withColumn("is_s2", F.col("is_s2").cast("int")))
        more = self._stage("features/train_group", lambda: grouped(scored, records).drop("p1"))
        second = scored.join(more, ["part", "a", "b"])
        two = FoldEnsemble(STAGE_TWO, self.config.trees).fit(sample(second, self.config.stage2_sample, 2), n_folds=n)
        src = records.filter("side = 2").select("part", F.col("rid").alias("b"), "src")
        final = self._stage("scores/train_p", lambda: two.predict(second, "p", fold="fold").join(src, ["part", "b"]).select(F.col("part"), F.col("a").alias("s1"), F.col("b").alias("eid"), "src", "fold", "p1", "p", F.col("y")))
        rules = self.tuned(D.one_to_one(final), records, truth, final)
        if not reuse_stage1:
            one.save(f"{self.model_dir}/stage1")
        two.save(f"{self.model_dir}/stage2")
        T.save_json(self.spark, rules, f"{self.model_dir}/rules")
        return {"stage1": one, "stage2": two, "rules": rules}

    def tuned(self, best: DataFrame, records: DataFrame, truth: DataFrame, scored: DataFrame) -> dict:
        """By part, each rule is tuned on one fold's entities and judged on the others'; the method that is best over all parts,
        weighted by their entities, is chosen, and tuned on all of a part. Unseen parts get a stricter default."""
        entities = records.filter("side = 1").select(F.col("rid").alias("s1"), F.col("part"), fold_of(F.xxhash64("rid"), self.config.n_folds).alias("fold")).persist()
        parts = sorted(r[0] for r in best.join(truth.select("s1").distinct(), "s1", "left_semi").select("part").distinct().collect())
        pooled = D.fit_isotonic(scored)
        methods, rules, held_out = self.config.methods, {}, {m: [] for m in self.config.methods}

        def tune(method: str, rows, ents, knots):
            if method == "thr":
                return D.tune_thresholds(rows, ents, truth, sources)[0]
            if method == "ef":
                return D.tune_expected_f(rows, ents, truth)[0]
            return D.tune_lam(rows.withColumn("q", D.calibrated(F.col("p"), knots)), ents, truth)[0]

        for part in parts:
            rows = best.filter(F.col("part") == part).persist()
            sources = sorted(r[0] for r in rows.select("src").distinct().collect())
            own = entities.filter(F.col("part") == part)
            knots = D.fit_isotonic(scored.filter(F.col("part") == part))
            for k in range(self.config.n_folds):
                inside, outside = own.filter(F.col("fold") == k), own.filter(F.col("fold") != k)
                n = outside.count()
                for m in methods:
                    rule = {"thr": {s: 0.5 for s in sources}, "ef": {"gamma": 1.0, "missed": 0.0, "floor": 0.05}, "lam": 0.0, "knots": knots}
                    rule["lam" if m == "exact" else m] = tune(m, rows.join(inside.select("s1"), "s1", "left_semi"), inside, knots)
                    picked = self.decide(rows.join(outside.select("s1"), "s1", "left_semi"), {"method": m, "parts": {part: rule}, "unseen": R.unseen_rule({part: rule}), "pooled": pooled})
                    f = entity_scores(outside.select("s1"), truth.join(outside.select("s1"), "s1", "left_semi"), picked).agg(F.avg("f05")).first()[0] or 0.0
                    held_out[m].append((k, n, f))
            rules[part] = {"thr": tune("thr", rows, own, knots), "ef": tune("ef", rows, own, knots), "lam": tune("exact", rows, own, knots), "knots": knots}
            rows.unpersist()
        value = {m: weighted_mean(held_out[m]) for m in methods}
        entities.unpersist()
        unlabelled = {"temperature": self.config.unlabelled_temperature, "lam": self.config.unlabelled_lam, "offsets": self.config.bucket_offsets}
        return {"method": max(methods, key=lambda m: value[m]), "held_out": value, "parts": rules, "unseen": R.unseen_rule(rules), "pooled": pooled, "unlabelled": unlabelled}

    @staticmethod
    def decide(best: DataFrame, rules: dict) -> DataFrame:
        """best: one-to-one pairs (part, s1, eid, src, p, and the shape as bucket where offsets are set). Returns (s1, eid, p)."""
        if rules["method"] == "thr":
            out = R.by_thresholds(best, rules["parts"], rules["unseen"])
        elif rules["method"] == "ef":
            out = R.by_expected_f(best, rules["parts"], rules["unseen"])
        else:
            out = R.by_exact_f(best, rules["parts"], rules["pooled"], **rules.get("unlabelled", {}), bucket="bucket" if "bucket" in best.columns else None)
        return out.select("s1", "eid", "p")

    def predict(self, split: str, records: DataFrame, found: DataFrame, models: dict) -> DataFrame:
        """Matches (s1, eid, p); parts without labels are decided by the rules' default."""
        base = self.features(split, records, found)
        scored = self._stage(f"scores/{split}_p1", lambda: models["stage1"].predict(base, "p1").withColumn("is_s2", F.col("is_s2").cast("int")))
        both = scored.join(grouped(scored, records).drop("p1"), ["part", "a", "b"])
        src = records.filter("side = 2").select("part", F.col("rid").alias("b"), "src")
        final = self._stage(f"scores/{split}_p", lambda: models["stage2"].predict(both, "p").join(src, ["part", "b"]).select("part", F.col("a").alias("s1"), F.col("b").alias("eid"), "src", "rank", "p1", "p"))
        best, rules = D.one_to_one(final), models["rules"]
        if rules["unlabelled"]["offsets"]:
            side = lambda n, k: records.filter(F.col("side") == n).select("part", F.col("rid").alias(k), F.col("a_house").alias(f"h_{k}"), F.col("n_core").alias(f"c_{k}"))
            best = best.join(side(1, "s1"), ["part", "s1"]).join(side(2, "eid"), ["part", "eid"])
            best = best.withColumn("bucket", D.shape_bucket(F.col("h_s1"), F.col("h_eid"), F.col("c_s1"), F.col("c_eid")))
        return self.decide(best, rules)

    def write(self, entities: DataFrame, found: DataFrame, matches: DataFrame, out: str) -> None:
        T.write_tsv(T.id_lists(entities, found.select(F.col("a").alias("s1"), F.col("b").alias("eid"), "rank"), "rank", "candidate_entity_ids"), f"{out}/candidate_pairs.tsv")
        T.write_tsv(T.id_lists(entities, matches, "p", "matched_entity_ids", descending=True), f"{out}/matching_results.tsv")

    def load(self) -> dict:
        m = self.model_dir
        return {"stage1": FoldEnsemble.load(f"{m}/stage1", STAGE_ONE), "stage2": FoldEnsemble.load(f"{m}/stage2", STAGE_TWO), "rules": T.load_json(self.spark, f"{m}/rules")}

    def words(self, train: dict[str, DataFrame] | None = None, truth: DataFrame | None = None) -> dict[str, str]:
        """The dictionary of native words: learned from the training tables and saved, or as saved."""
        path = f"{self.model_dir}/translit"
        if train is not None:
            T.save_json(self.spark, learn_dictionary(train, truth), path)
        return T.load_json(self.spark, path)


def validate(spark: SparkSession, entities: DataFrame, records: DataFrame, out: str) -> dict[str, int]:
    """Counts of faults in the written results: entities without a row or with several, ids that no record has."""
    faults = {}
    for file, column in (("candidate_pairs.tsv", "candidate_entity_ids"), ("matching_results.tsv", "matched_entity_ids")):
        rows = T.read_tsv(spark, f"{out}/{file}", ("source1_entity_id", column))
        counts = entities.select("s1").distinct().join(rows.groupBy(F.col("source1_entity_id").alias("s1")).agg(F.count(F.lit(1)).alias("n")), "s1", "left")
        faults[f"{file}: not one row"] = counts.filter(F.coalesce("n", F.lit(0)) != 1).count()
        faults[f"{file}: unknown id"] = T.exploded_truth(rows, right=column).join(records.select("eid"), "eid", "left_anti").count()
    return faults


def evaluate(entities: DataFrame, truth: DataFrame, matches: DataFrame, by: str | None = None) -> DataFrame:
    return report(entity_scores(entities, truth, matches), by)
