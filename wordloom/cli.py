"""python -m wordloom STEP ...: the steps of plans.files from a shell. Run it through spark-submit for a cluster."""

from __future__ import annotations

import argparse
from dataclasses import MISSING, fields

from pyspark.sql import SparkSession

from wordloom.config import CooccurOptions, SaveOptions, TrainOptions, VocabOptions
from wordloom.plans import files

#: Steps, the files they take, and the groups of options that they have.
STEPS = {
    "vocab-count": (("corpus", "vocab-file"), (VocabOptions,)),
    "cooccur": (("corpus", "vocab-file", "pair-file"), (CooccurOptions,)),
    "shuffle": (("pair-file", "shuffled-file"), ()),
    "train": (("pair-file", "vocab-file", "save-file"), (TrainOptions, SaveOptions)),
    "evaluate": (("vocab-file", "vectors-file", "questions"), ()),
    "all": (("corpus", "save-file"), (VocabOptions, CooccurOptions, TrainOptions, SaveOptions)),
}


def _flag(text: str) -> bool:
    if text.lower() not in ("0", "1", "true", "false"):
        raise argparse.ArgumentTypeError(f"{text}: 0 or 1")
    return text.lower() in ("1", "true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wordloom", description="Word vectors from text, on Spark.")
    steps = top.add_subparsers(dest="step", required=True)
    for name, (paths, groups) in STEPS.items():
        own = steps.add_parser(name)
        for p in paths:
            own.add_argument(f"--{p}", required=True)
        for group in groups:
            for f in fields(group):
                default = f.default if f.default is not MISSING else None
                own.add_argument(f"--{f.name.replace('_', '-')}", type=_flag if isinstance(default, bool) else type(default), default=default, help=f"default: {default}")
        if name == "shuffle":
            own.add_argument("--seed", type=int, default=0)
        if name == "train":
            own.add_argument("--folder", help="where kept iterations are; a new folder of the shared one by default")
            own.add_argument("--resume", type=_flag, default=False)
            own.add_argument("--init-param-file")
            own.add_argument("--init-gradsq-file")
    return top


def _options(group, given: argparse.Namespace):
    return group(**{f.name: getattr(given, f.name) for f in fields(group)})


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("wordloom").getOrCreate()
    if given.step == "vocab-count":
        files.count_words(spark, given.corpus, given.vocab_file, _options(VocabOptions, given))
    elif given.step == "cooccur":
        files.count_pairs(spark, given.corpus, given.vocab_file, given.pair_file, _options(CooccurOptions, given))
    elif given.step == "shuffle":
        files.shuffle_pairs(spark, given.pair_file, given.shuffled_file, given.seed)
    elif given.step == "train":
        start = files.given_start(spark, given.vector_size, given.init_param_file, given.init_gradsq_file)
        show(files.fit(spark, given.pair_file, given.vocab_file, given.save_file, _options(TrainOptions, given), _options(SaveOptions, given), given.folder, given.resume, start))
    elif given.step == "evaluate":
        show(files.evaluate(spark, given.vocab_file, given.vectors_file, given.questions).orderBy("level", "name"))
    else:
        show(files.text_to_vectors(spark, given.corpus, given.save_file, *(_options(g, given) for g in STEPS["all"][1])))


def show(report) -> None:
    """Prints a report, which is a few rows: iterations, or categories."""
    print("\t".join(report.columns))
    for r in report.toLocalIterator():
        print("\t".join(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r))
