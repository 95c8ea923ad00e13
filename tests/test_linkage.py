
import pytest
from linkspark.operators.pairs import content_core, featurised, with_imputed_states
from linkspark.operators.retrieve import Depth, candidates, depths
from linkspark.operators.split import learned_words, without_frequent_ids
from linkspark.plans.linkage import Config, Linkage, normalised
from linkspark.sources import tables as T

# fixed inputs, whose results are known
LEFT = [("S1-0", "Robbie Garza Laboratories", "61 Scarborough Village Drive, Dayton, OH"), ("S1-1", "Beam Boral Co", "111 Mansfield Avenue, Shelby, OH"), ("S1-2", "Primary Care Group", "49 Ridge Drive, Mountain Brook, AL")]
RIGHT = [("S2-0", "Robbie Garza Laboratories Inc.", "61A SCARBOROUGH VILLAGE DR, DAYTON, OH"), ("S2-1", "Beam Boal Co", "#111 Mansfield Ave, Shelby, Ohio"), ("S2-2", "primarycaregroup.com", "49 RIDGE DR, MOUNTAIN BROOK, AL"), ("S2-3", "Primary Care Group", "12 Oak Street, Dallas, TX")]
SMALL = Depth(k_comb=3, k_name=2, k_addr=2, max_df_word=100, max_df_char=100)


def records(spark, left, right, country="US"):
    rows = [(*r, country, "S1") for r in left] + [(*r, country, "S2") for r in right]
    return normalised(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, src string"))


@pytest.fixture(scope="module")
def found(spark):
    r = records(spark, LEFT, RIGHT).persist()
    return r, candidates(r, SMALL).persist()


def test_first_candidates_are_the_matches(found):
    first = {(x.a, x.b) for x in found[1].filter("rank = 1").collect()}
    assert first == {("S1-0", "S2-0"), ("S1-1", "S2-1"), ("S1-2", "S2-2")}


def test_features_of_pairs(found):
    rows = {(x.a, x.b): x for x in featurised(found[1], found[0]).collect()}
    pair = rows["S1-1", "S2-1"]
    assert pair.house_eq == 1 and pair.state_match == 1 and pair.core_ratio > 90 and pair.addr_cos > 0.9
    assert rows["S1-0", "S2-0"].name_cont_ab == pytest.approx(1.0)
    assert all(0 <= x.name_cos <= 1 + 1e-9 and 0 <= x.char_cos <= 1 + 1e-9 for x in rows.values())


def test_glued_initials(spark):
    left = [("S1-0", "Jai Infrastructure Private Limited", "67/11 Strand Road, Kolkata")]
    right = [("S2-0", "jiprivate.com", "67/11 Strand Road, Calcutta, WB"), ("S2-1", "Jai Infrastructure Pvt Ltd", "67/11 Strand Road, Kolkata")]
    r = records(spark, left, right, "India")
    rows = {x.b: x for x in featurised(candidates(r, SMALL), r).collect()}
    assert rows["S2-0"].acr_prefix == 3 and rows["S2-0"].acr_rest >= 0
    assert (rows["S2-1"].acr_prefix, rows["S2-1"].acr_rest) == (-1, -1)


def test_clipped_house_numbers_meet(spark):
    left = [("S1-0", "Glad Vasquez DDS", "2424 Peach Avenue, Marshfield, WI"), ("S1-1", "Other Co", "12 Elm Street, Austin, TX")]
    right = [("S2-0", "Calodelta", "424 PEACH AVENUE, MARSHIELD, WI"), ("S2-1", "Zeta", "9 Oak Rd, Boise, ID")]
    r = records(spark, left, right)
    rows = {(x.a, x.b): x for x in featurised(candidates(r, SMALL), r).collect()}
    assert rows["S1-0", "S2-0"].house_trunc == 1


def test_content_core(spark):
    left = [("S1-0", "Tourcoing Ecole SARL", "12 Rue Lyderic, Tourcoing, Nord")]
    right = [("S2-0", "Tourcoing Amis SARL", "12 Rue Lyderic, Tourcoing, Nord"), ("S2-1", "Ecole Tourcoing", "12 R. Lyderic, Tourcoing")]
    r = records(spark, left, right, "France")
    side = lambda n, k: r.filter(f"side = {n}").selectExpr("part", f"rid as {k}", f"n_core as core_{k}", f"a_loc as loc_{k}")
    rows = {x.b: x for x in content_core(side(1, "a").join(side(2, "b"), "part"), r).collect()}
    assert (rows["S2-0"].cc_disjoint, rows["S2-0"].cc_jacc) == (1, 0) and (rows["S2-1"].cc_disjoint, rows["S2-1"].cc_jacc) == (0, 1)


def test_states_are_imputed_from_localities(spark):
    rows = [("FR", "bordeaux", "nouvelle aquitaine")] * 6 + [("FR", "bordeaux", ""), ("FR", "nowhere", "")]
    got = with_imputed_states(spark.createDataFrame(rows, "part string, a_loc string, a_state string")).filter("a_loc = 'nowhere' or a_state <> ''")
    assert sorted((x.a_loc, x.a_state) for x in got.collect()) == [("bordeaux", "nouvelle aquitaine")] * 7 + [("nowhere", "")]


def test_depth_follows_the_share_of_other_scripts(spark):
    rows = [("IN", 1, 0)] + [("IN", 2, int(k < 18)) for k in range(100)] + [("US", 1, 0)] + [("US", 2, 0)] * 5
    got = {x.part: x.k_comb for x in depths(spark.createDataFrame(rows, "part string, side int, is_native int"), Depth()).collect()}
    assert got == {"IN": 40, "US": 25}


def test_dictionary_is_learned_from_pairs(spark):
    rows = [("Laxmi Investment", "लक्ष्मी इन्वेस्टमेंट")] * 2 + [("Rare Investment", "दुर्लभ इन्वेस्टमेंट")]
    got = {x.native_word: x.word for x in learned_words(spark.createDataFrame(rows, "l string, n string"), "l", "n").collect()}
    assert got == {"लक्ष्मी": "laxmi", "इन्वेस्टमेंट": "investment"}


def test_frequent_ids_go(spark):
    rows = [("a", "x,y"), ("b", "x"), ("c", "z,x"), ("d", "")]
    got = {x.k: x.ids for x in without_frequent_ids(spark.createDataFrame(rows, "k string, ids string"), "ids", 2).collect()}
    assert got == {"a": "y", "b": "", "c": "z", "d": ""}


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("S1-0", 'a "quoted" name', "", "US")], "entity_id string, business_name string, business_address string, country string")
    T.write_tsv(df, f"{tmp_path}/t.tsv")
    assert T.read_tsv(spark, f"{tmp_path}/t.tsv").collect() == df.collect()


def test_pipeline_end_to_end(spark, tmp_path):
    """Thirty businesses with noisy copies, trained on themselves; the matches come out."""
    left, right, truth = [], [], []
    words = "amber birch cedar dover ember fjord grove haven ivory jewel knoll lotus maple north ocean pearl quartz river stone tulip umber vista wharf xenon yarrow zephyr acorn basil coral delta".split()
    for k, w in enumerate(words):
        left.append((f"S1-{k}", f"{w} trading {words[-k - 1]}", f"{100 + 7 * k} {w} street, {words[(k * 3) % 30]}ville, OH"))
        right.append((f"S2-{k}", f"{w.upper()} Trading {words[-k - 1]} Inc", f"#{100 + 7 * k} {w} St, {words[(k * 3) % 30]}ville, Ohio"))
        truth.append((f"S1-{k}", f"S2-{k}"))
    schema = "entity_id string, business_name string, business_address string, country string"
    frame = lambda rows: spark.createDataFrame([(*r, "US") for r in rows], schema)
    sources = {"S1": frame(left), "S2": frame(right), "S3": frame([("S3-0", "unlike anything", "9 far road, nowhere, TX")])}
    true = spark.createDataFrame(truth, "s1 string, eid string")
    few = Config(SMALL, trees={"maxIter": 3, "stepSize": 0.3, "maxDepth": 2, "seed": 42}, methods=("exact",))
    run = Linkage(spark, f"file://{tmp_path}/work", few)
    records_, found_ = run.prepare("train", sources)
    models = run.train(records_, found_, true)
    matches = run.predict("again", records_, found_, models)
    hits = matches.join(true, ["s1", "eid"], "left_semi").count()
    assert hits >= 25 and matches.count() <= 35 and models["rules"]["method"] == "exact"
    run.write(sources["S1"].selectExpr("entity_id as s1"), found_, matches, f"file://{tmp_path}/out")
    from linkspark.plans.linkage import validate

    eids = sources["S2"].unionByName(sources["S3"]).selectExpr("entity_id as eid")
    assert set(validate(spark, sources["S1"].selectExpr("entity_id as s1"), eids, f"file://{tmp_path}/out").values()) == {0}
    assert run.load()["rules"] == models["rules"]


def test_cross_fitted_trees(spark, tmp_path):
    """Model k is fitted without fold k and scores it; other rows get the mean; saved models score alike."""
    from linkspark.operators.model import FoldEnsemble
    from linkspark.operators.split import fold_of
    from pyspark.sql import functions as F

    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), F.when(F.col("id") % 7 == 0, None).otherwise(1.0).alias("z"), (F.col("id") % 20 >= 10).cast("int").alias("y"), fold_of(F.col("id")).alias("fold"))
    few = {"maxIter": 2, "maxDepth": 2, "seed": 42}
    made = FoldEnsemble(("x", "z"), few).fit(df)
    got = made.predict(df, "p", fold="fold").toPandas()
    assert ((got.p > 0.5) == (got.y == 1)).all() and got.columns.tolist() == [*df.columns, "p"]
    wrong = df.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    other = FoldEnsemble(("x", "z"), few).fit(wrong).predict(df, "p", fold="fold").toPandas()
    assert ((other.p > 0.5) == (other.y == 1))[other.fold == 0].all()  # fold 0's model has not seen its wrong labels
    assert not ((other.p > 0.5) == (other.y == 1))[other.fold == 1].any()
    both = made.predict(df, "p").orderBy("id").toPandas().p
    alone = [FoldEnsemble(("x", "z"), models=[m]).predict(df, "p").orderBy("id").toPandas().p for m in made.models]
    assert both.to_numpy() == pytest.approx(((alone[0] + alone[1]) / 2).to_numpy())
    assert made.importance(1)[0][0] == "x"
    made.save(f"file://{tmp_path}/m")
    again = FoldEnsemble.load(f"file://{tmp_path}/m", ("x", "z"))
    assert again.predict(df, "p").orderBy("id").toPandas().p.to_numpy() == pytest.approx(both.to_numpy())
    with pytest.raises(ValueError):
        FoldEnsemble(("x", "none"), few).fit(df)


def test_folds_of_any_number(spark):
    from linkspark.operators.split import fold_of
    from pyspark.sql import functions as F

    numbers = [0, 5, -3, 1 << 62, -(1 << 63), (1 << 63) - 1]
    got = [r.f for r in spark.createDataFrame([(n,) for n in numbers], "n bigint").select(fold_of(F.col("n"), 3).alias("f")).collect()]
    assert got == [((n * 2654435761 + 7) % 1000003) % 3 for n in numbers]


def test_the_command_line_has_its_options():
    from linkspark.cli import parser

    o = parser().parse_args("--mode predict --train-dir a --test-dir b --output-dir c --work-dir d --model-dir e --validator f --reuse-stage1 --block-countries X Y --stage1-sample 0.5 --stage2-sample 0.25".split())
    assert (o.mode, o.model_dir, o.validator, o.reuse_stage1, o.block_countries, o.stage1_sample, o.stage2_sample) == ("predict", "e", "f", True, ["X", "Y"], 0.5, 0.25)
