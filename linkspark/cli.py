"""The command line: prepare, train, predict, validate, all of them, or evaluate results against a truth."""

from __future__ import annotations

import argparse
import subprocess
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkspark.plans.linkage import Config, Linkage, evaluate, validate
from linkspark.sources import tables as T


def parser() -> argparse.ArgumentParser:
    args = argparse.ArgumentParser(prog="linkspark")
    args.add_argument("--mode", choices=["all", "prepare", "train", "predict", "validate", "evaluate"], default="all")
    for name in ("train-dir", "test-dir", "output-dir", "work-dir"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--model-dir", default="", help="models, rules and the dictionary; default: below the work folder")
    args.add_argument("--validator", help="a script that is run on the results after the own checks")
    args.add_argument("--truth", help="evaluate: the ground truth of the results; default: that of the training folder")
    args.add_argument("--reuse-stage1", action="store_true", help="keep the saved models of stage one")
    args.add_argument("--force", action="store_true", help="make all stages anew")
    args.add_argument("--train-countries", nargs="*")
    args.add_argument("--predict-countries", nargs="*")
    args.add_argument("--block-countries", nargs="*", help="prepare these countries only, as a stage of their own")
    args.add_argument("--stage1-sample", type=float, default=1.0, help="share of entities that stage one is fitted on")
    args.add_argument("--stage2-sample", type=float, default=1.0)
    return args


def main(argv: Sequence[str] | None = None) -> int:
    o = parser().parse_args(argv)
    spark = SparkSession.builder.appName("linkspark").getOrCreate()
    run = Linkage(spark, o.work_dir, Config(stage1_sample=o.stage1_sample, stage2_sample=o.stage2_sample), force=o.force, model=o.model_dir)
    every = lambda *modes: o.mode in (*modes, "all")

    def within(folder: str, split: str, names: Sequence[str] | None) -> dict:
        names = [x for x in (names or o.block_countries or []) if not o.block_countries or x in o.block_countries]
        return {k: v.filter(F.col("country").isin(names)) if names else v for k, v in run.sources(folder, split).items()}

    test = within(o.test_dir, "test", o.predict_countries)
    entities = test["S1"].select(F.col("entity_id").alias("s1"))
    models = None
    if every("prepare", "train"):
        train = within(o.train_dir, "train", o.train_countries)
        truth = T.read_truth(spark, f"{o.train_dir}/train_ground_truth.tsv")
        records, found = run.prepare("train", train, run.words(train, truth))
        if every("train"):
            models = run.train(records, found, truth, reuse_stage1=o.reuse_stage1)
    if every("prepare", "predict"):
        records, found = run.prepare("test", test, run.words())
        if every("predict"):
            run.write(entities, found, run.predict("test", records, found, models or run.load()), o.output_dir)
    if every("validate"):
        faults = validate(spark, entities, test["S2"].unionByName(test["S3"]).select(F.col("entity_id").alias("eid")), o.output_dir)
        print(faults)
        if o.validator:
            files = ["--matching", f"{o.output_dir}/matching_results.tsv", "--candidate", f"{o.output_dir}/candidate_pairs.tsv", "--test-dir", o.test_dir]
            return subprocess.run([sys.executable, o.validator, *files], check=False).returncode
        return int(any(faults.values()))
    if o.mode == "evaluate":
        truth = T.read_truth(spark, o.truth or f"{o.train_dir}/train_ground_truth.tsv")
        matches = T.read_truth(spark, f"{o.output_dir}/matching_results.tsv")
        for by in (None, "country"):
            evaluate(test["S1"].select(F.col("entity_id").alias("s1"), "country"), truth, matches, by).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
