"""Command line: python -m tokenloom.cli COMMAND. Works on local or shared paths that Spark can read."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.text import ALPHABET, SPLITS, special_tokens
from tokenloom.operators import bpe, counting, sampling, vocabulary
from tokenloom.plans import experiment
from tokenloom.session import ship
from tokenloom.sources import readers, writers


def positive(value: str) -> int:
    n = int(value)
    if n <= 0:
        raise argparse.ArgumentTypeError("must be positive")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tokenloom", description=__doc__)
    c = p.add_subparsers(dest="command", required=True)
    s = c.add_parser("sample", help="take the first rows of each source folder")
    s.add_argument("--base", required=True), s.add_argument("--sources", nargs="+", required=True), s.add_argument("--rows", type=positive, required=True), s.add_argument("--out", required=True)
    for name, text in (("frequent", "most frequent pretokens"), ("bpe", "BPE"), ("picky", "BPE with deletions"), ("lp", "linear program")):
        s = c.add_parser(name, help=f"make a vocabulary: {text}")
        s.add_argument("--corpus", required=True), s.add_argument("--size", type=positive, nargs="+", required=True), s.add_argument("--out", required=True), s.add_argument("--mode", choices=sorted(SPLITS), default="nanochat")
    s = c.add_parser("round", help="round fractional vocabularies and write tokenizers")
    s.add_argument("--values", required=True), s.add_argument("--out", required=True), s.add_argument("--schemes", nargs="+", default=["all_ones", "det", "bias"]), s.add_argument("--mode", choices=sorted(SPLITS), default="nanochat"), s.add_argument("--seed", type=int, default=0)
    s = c.add_parser("experiment", help="overlap of vocabularies of several samples")
    s.add_argument("--corpus", required=True), s.add_argument("--size", type=positive, nargs="+", required=True), s.add_argument("--samples", type=positive, default=5), s.add_argument("--rows", type=positive, required=True), s.add_argument("--out", required=True), s.add_argument("--seed", type=int, default=0)
    s = c.add_parser("vocab-size", help="size of a tokenizer.json")
    s.add_argument("path")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "vocab-size":
        print(len(readers.tokenizer_vocabulary(a.path)))
        return 0
    spark = SparkSession.builder.appName("tokenloom").getOrCreate()
    ship(spark)
    if a.command == "sample":
        docs = readers.read_sources(spark, a.base, a.sources).withColumn("doc_id", F.monotonically_increasing_id())
        quotas = sampling.equal_quotas(a.sources, a.rows)
        made = sampling.first_rows(docs, quotas)
        writers.save_sample(made, a.out, {"target_rows": a.rows, "quotas": quotas, "selection_strategy": "first rows"})
        missing = sampling.unfilled(spark.read.parquet(f"{a.out}/data"), quotas)
        if missing:
            print(json.dumps({"unfilled": missing}))
            return 1
        return 0
    if a.command == "round":
        values = readers.raw_vocabularies(spark, a.values)
        specials = special_tokens(a.mode)
        for size in [r.vocab_size for r in values.select("vocab_size").distinct().orderBy("vocab_size").collect()]:
            sets = experiment.rounding_sets(values.where(F.col("vocab_size") == size), size, specials, a.seed)
            for scheme in a.schemes:
                if scheme != "all_ones":
                    vocabulary.check_size(sets[scheme], size)
                writers.save_tokenizer(sets[scheme], f"{a.out}/{scheme}_{size}", specials, a.mode)
        return 0
    docs = readers.read_corpus(spark, a.corpus)
    if a.command == "experiment":
        experiment.run(spark, docs.withColumn("doc_id", F.xxhash64("text")), a.out, a.size, a.samples, a.rows, a.seed)
        return 0
    specials = special_tokens(a.mode)
    if a.command == "lp":
        joined = None
        for size, table in experiment.LPVocabulary(docs, a.mode).solve(a.size).items():
            part = table.withColumn("vocab_size", F.lit(size))
            joined = part if joined is None else joined.unionByName(part)
        writers.save_vocabularies(joined, a.out)
        return 0
    counts = counting.pretoken_counts(docs, a.mode).cache()
    for size in sorted(set(a.size)):
        if a.command == "frequent":
            writers.save_tokenizer(vocabulary.frequent(counts, size, [*specials, *ALPHABET]), f"{a.out}/frequent_{size}", specials, a.mode)
        elif a.command == "bpe":
            tokens, _ = bpe.train(bpe.load_words(counts), size, specials)
            writers.save_tokenizer(spark.createDataFrame(list(enumerate(tokens)), "id long, token string"), f"{a.out}/bpe_{size}", specials, a.mode)
        else:
            made = bpe.Picky(bpe.load_words(counts))
            tokens = made.train(size - len(specials))
            writers.save_model(f"{a.out}/picky_{size}.model", "word", "|".join(SPLITS[a.mode]), tokens, {s: len(tokens) + i for i, s in enumerate(specials)}, made.events)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
