"""Experiments: vocabularies of several samples and sizes, their overlap, and reports. Steps whose results exist are skipped."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.text import ALPHABET, special_tokens
from tokenloom.operators import bpe, counting, lp, sampling, vocabulary
from tokenloom.session import materialize
from tokenloom.sources import writers


class LPVocabulary:
    """Vocabularies of one corpus: counted once, solved for one or more sizes."""

    def __init__(self, docs: DataFrame, mode: str = "nanochat", pretokens: int = 20_000, min_count: int = 1, most: int | None = None):
        self.specials = special_tokens(mode)
        counts = vocabulary.best(counting.pretoken_counts(docs, mode), pretokens, [F.desc("frequency"), F.asc("pretoken")]).drop("rank")
        self.counts = materialize(counts, "counts")
        self.tokens = counting.token_ids(counting.candidate_counts(self.counts, min_count, most))
        self.edges = counting.edges(self.counts, self.tokens, most)

    def budget(self, size: int) -> int:
        left = size - len(ALPHABET) - len(self.specials)
        if left <= 0:
            raise ValueError(f"vocabulary size {size} leaves no room beside the alphabet and special tokens")
        return left

    def solve(self, sizes: list[int], **options) -> dict[int, DataFrame]:
        """(token, token_id, lp_value, instance_count) for each size; all sizes are checked before any work."""
        budgets = {size: self.budget(size) for size in sorted(set(sizes))}
        graph = lp.load(self.counts, self.edges)
        found = lp.sweep(graph, list(budgets.values()), **options)
        return {size: lp.as_table(self.counts.sparkSession, graph, found[b]) for size, b in budgets.items()}


def rounding_sets(values: DataFrame, size: int, specials: list[str], seed: int, least: float = 0.99) -> dict[str, DataFrame]:
    """Vocabularies of one solution by each rounding scheme."""
    return {
        "all_ones": vocabulary.all_ones(values, ALPHABET, specials, least),
        "det": vocabulary.deterministic(values, size, ALPHABET, specials),
        "bias": vocabulary.biased(values, size, ALPHABET, specials),
        "prob": vocabulary.probabilistic(values, size, ALPHABET, seed, specials, least),
    }


def run(spark: SparkSession, docs: DataFrame, folder: str, sizes: list[int], samples: int, rows: int, seed: int = 0, mode: str = "nanochat", **options) -> dict:
    """Draw samples, solve, round, train BPE baselines, compare; results land in ``folder``."""
    out = Path(folder)
    summary: dict = {"samples": samples, "rows": rows, "sizes": sorted(set(sizes)), "seconds": {}}
    specials = special_tokens(mode)
    for i in range(samples):
        target = out / f"sample_{i}" / "values"
        if not (target / "_SUCCESS").exists():
            began = time.time()
            sample = sampling.hash_sample(docs, rows, seed + i)
            made = LPVocabulary(sample, mode)
            tables = made.solve(sizes, **options)
            joined = None
            for size, table in tables.items():
                part = table.withColumn("vocab_size", F.lit(size))
                joined = part if joined is None else joined.unionByName(part)
            writers.save_vocabularies(joined, str(target))
            words = bpe.load_words(made.counts)
            rest = [(size, t) for size in sorted(set(sizes)) for t in bpe.train(words, size, specials)[0][len(specials) :]]
            spark.createDataFrame(rest, "vocab_size int, token string").write.mode("overwrite").partitionBy("vocab_size").parquet(str(out / f"sample_{i}" / "bpe"))
            summary["seconds"][f"sample_{i}"] = round(time.time() - began, 2)
    results: dict = {}
    for size in sorted(set(sizes)):
        by_method: dict[str, DataFrame] = {}
        for i in range(samples):
            values = spark.read.parquet(str(out / f"sample_{i}" / "values")).where(F.col("vocab_size") == size)
            sets = rounding_sets(values, size, [], seed)
            sets["bpe"] = spark.read.parquet(str(out / f"sample_{i}" / "bpe")).where(F.col("vocab_size") == size)
            for method, table in sets.items():
                part = table.select(F.lit(f"sample_{i}").alias("sample"), "token")
                by_method[method] = part if method not in by_method else by_method[method].unionByName(part)
        results[str(size)] = {m: writers.save_overlap(str(out / "overlap" / str(size) / m), vocabulary.jaccard_pairs(t), vocabulary.jaccard_by_length(t)) for m, t in by_method.items()}
    (out / "results.json").write_text(json.dumps(results, indent=2, ensure_ascii=False), "utf-8")
    (out / "run_summary.json").write_text(json.dumps(summary, indent=2), "utf-8")
    return results
