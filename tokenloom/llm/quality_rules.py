"""Quality rules with an isolation forest.

For each document rule statistics are taken from the whole text. Words are runs without ASCII white
space. The base rule rejects a document with fewer than 50 words or in which more than half of the
words lie in three-word windows that occur twice or more. All others are judged by an isolation forest
(Liu, Ting and Zhou, 2008) over the statistics as rates: every tree splits a small sample at random
features and values; documents that random splits isolate early, on short paths, are anomalous.

A plain forest calls anything rare anomalous and misses junk that is common. Here the trees grow on rows
labelled good, and their splits are drawn from the span of all labelled rows, so the space that good
documents leave empty is cut off on short paths, however many bad ones lie there. The threshold on the
score is the one that best separates labelled rows of quality 0 from those of quality 1 (F1 of the
rejected, over labelled rows that the base rule passes), among those that reject at most
``FALSE_REJECTS`` of the good ones.

Every labelled row that the base rule passes takes part in both. The span is that of all of them; a tree
draws its ``SAMPLE`` rows (the method's own; half of the good rows at most) from all good ones; the
threshold is taken over the scores of all, each scored only by trees that have not drawn it (by all trees
if each has). Rows stay in Spark: what reaches the driver is the span, the trees' samples and the
threshold, whose size doesn't grow with the labels. Only counts move, no texts. Of a doc_id with several texts
one is used, that of the smallest counts. The verdict covers every document in one pass without a shuffle.

Null or empty text: all counts 0, base_failed. Null doc_ids are judged but not used for fitting. With no
labelled row of one of the two qualities nothing but the base rule rejects. Extra columns stay,
except that one with the name of a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm._common import WordHashes, blocks, documents, materialize, mix, plus, without
from tokenloom.operators.counting import dense_ids

MIN_WORDS = 50
TREES = 200
SAMPLE = 256
FALSE_REJECTS = 0.01
SEED = 20

_SYMBOLS = regex.compile(r"[#*$%&|<>]")
_MARKS = regex.compile(r"[!?]")
_UPPER = regex.compile(r"\p{Lu}")
_DIGITS = regex.compile(r"\d")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_marks", "n_digits", "n_distinct", "n_same_next"]
FEATURES = ["word length", "symbols", "dup lines", "repeats", "upper", "marks", "digits", "distinct", "same next", "line length"]


RESULT = ", ".join(f"{n} long" for n in COUNTS) + ", anomaly double, base_failed boolean, kept boolean"


def statistics(text: str | None, hashes: WordHashes) -> list[int]:
    """The counts named in COUNTS and MORE, from the whole text."""
    if not text:
        return [0] * (len(COUNTS) + len(MORE))
    raw = text.encode()
    words = raw.split()
    n = len(words)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    if not n:
        return [0, 0, 0, dup, 0, lines, 0, 0, 0, 0, 0]
    h = hashes.of(words)
    covered = 0
    if n >= 3:
        windows = mix(mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + h[2:])
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(n, bool)
        if same.any():
            hit = np.zeros(n - 2, bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            for k in range(3):
                twice[k : n - 2 + k] |= hit
        covered = int(twice.sum())
    chars = len(b"".join(words).decode())
    return [n, chars, len(_SYMBOLS.findall(text)), dup, covered, lines, len(_UPPER.findall(text)), len(_MARKS.findall(text)), len(_DIGITS.findall(text)), len(np.unique(h)), int(np.count_nonzero(h[1:] == h[:-1]))]


def rates(counts: np.ndarray) -> np.ndarray:
    """Features of the forest from counts (rows x counts)."""
    n, chars, symbols, dup, repeat, lines, upper, marks, digits, distinct, same = counts.astype(float).T
    w, c, at = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.stack([chars / w, np.sqrt(symbols / w), dup / at, repeat / w, np.sqrt(upper / c), np.sqrt(marks / w), np.sqrt(digits / c), distinct / w**0.9, same / w, np.log1p(w / at)], axis=1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeat = counts[:, 0], counts[:, 4]
    return (n < MIN_WORDS) | (100 * repeat > 50 * n)


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.maximum(n.astype(float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), value, left child (the right one follows), leaf depth."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    norm: float

    @classmethod
    def fit(cls, samples: list[np.ndarray], low: np.ndarray, high: np.ndarray, seed: int = SEED) -> Forest:
        """Grow a tree on each of ``samples``, which are of one size; the splits cover the span ``low`` to ``high``."""
        rng = np.random.default_rng(seed)
        made = []
        size = len(samples[0])
        deepest = int(np.ceil(np.log2(max(2, size)))) + 2
        for rows in samples:
            feature, value, left, depth = [], [], [], []

            def grow(node, own, lo, hi, d):
                # splits are drawn from the cell, not only from the span of its points: empty space
                # beside the points is cut off too, so values that no sampled row has isolate early
                wide = np.flatnonzero(hi > lo)
                if len(own) <= 1 or d >= deepest or not len(wide):
                    depth[node] = d + float(_average_path(np.array([len(own)]))[0])
                    return
                f = int(rng.choice(wide))
                v = rng.uniform(lo[f], hi[f])
                feature[node], value[node], left[node] = f, v, len(feature)
                for _ in range(2):
                    feature.append(-1), value.append(0.0), left.append(0), depth.append(0.0)
                at = left[node]
                below = own[:, f] < v
                cut_hi, cut_lo = hi.copy(), lo.copy()
                cut_hi[f] = cut_lo[f] = v
                grow(at, own[below], lo, cut_hi, d + 1)
                grow(at + 1, own[~below], cut_lo, hi, d + 1)

            feature.append(-1), value.append(0.0), left.append(0), depth.append(0.0)
            grow(0, rows, low.copy(), high.copy(), 0)
            made.append((np.array(feature), np.array(value), np.array(left), np.array(depth)))
        return cls(made, float(_average_path(np.array([size]))[0]) or 1.0)

    def score(self, x: np.ndarray, unseen: Callable[[int], np.ndarray] | None = None) -> np.ndarray:
        """Anomaly score in 0 to 1; near 1: isolated on short paths.

        ``unseen`` tells for the number of a tree which rows it hasn't drawn: only such trees score a row, if there are any.
        """
        total, own, trees = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
        for k, (feature, value, left, depth) in enumerate(self.trees):
            node = np.zeros(len(x), int)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.flatnonzero(inner)
                node[at] = left[node[at]] + (x[at, f[at]] >= value[node[at]])
            total += depth[node]
            if unseen is not None:
                free = unseen(k)
                own += np.where(free, depth[node], 0)
                trees += free
        return 2.0 ** (-np.where(trees > 0, own / np.maximum(trees, 1), total / len(self.trees)) / self.norm)


def draws(keys: np.ndarray, tree: int, seed: int = SEED) -> np.ndarray:
    """A random number of each row for a tree, which draws the rows of the smallest ones. ``keys``: hashes of doc_id."""
    salt = mix(np.array([seed << 32 | tree], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(keys.view(np.uint64) ^ salt)


@dataclass
class Model:
    forest: Forest | None
    threshold: float

    def rejects(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anomaly score and whether it is beyond the threshold."""
        if self.forest is None:
            return np.zeros(len(counts)), np.zeros(len(counts), bool)
        score = self.forest.score(rates(counts))
        return score, score > self.threshold


def calibrate(score: np.ndarray, bad: np.ndarray, false_rejects: float = FALSE_REJECTS) -> float:
    """Threshold of the best F1 for ``bad`` that rejects at most a share of the good ones."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(bad[order])
    wrong = np.arange(1, len(order) + 1) - hits
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + bad.sum())
    s = score[order]
    f1[:-1][s[1:] == s[:-1]] = 0
    f1[wrong > false_rejects * max(1, (~bad).sum())] = 0
    best = int(np.argmax(f1))
    if not f1[best]:
        return 2.0
    return float((s[best] + (s[best + 1] if best + 1 < len(s) else 0)) / 2)


def threshold(scores: DataFrame, bad: int, good: int, false_rejects: float = FALSE_REJECTS) -> float:
    """What ``calibrate`` gives, for a table (score, bad) of any size with so many bad and good rows."""
    levels = scores.groupBy("score").agg(F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good"))
    ranked = dense_ids(levels, [F.desc("score")], "place", {"hits": "n_bad", "wrong": "n_good"})
    hits, wrong = F.col("hits") + F.col("n_bad"), F.col("wrong") + F.col("n_good")
    best = ranked.where((hits > 0) & (wrong <= false_rejects * max(1, good))).select((2 * hits / (hits + wrong + bad)).alias("f1"), "score").orderBy(F.desc("f1"), F.desc("score")).first()
    if best is None:
        return 2.0
    below = ranked.where(F.col("score") < best.score).agg(F.max("score")).first()[0]
    return (best.score + (below or 0)) / 2


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with COUNTS and MORE in place of the text."""
    names = COUNTS + MORE
    at = docs.columns.index("text")
    rest = docs.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in blocks(batches):
            counts = np.array([statistics(t, hashes) for t in batch.column(at).to_pylist()], np.int64)
            own = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), *(pa.array(counts[:, k]) for k in range(len(names)))], [*(batch.schema.names[k] for k in own), *names])

    return docs.mapInArrow(run, plus(rest, ", ".join(f"{n} long" for n in names)))


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names], axis=1)


_RATES = [f"x{k}" for k in range(len(FEATURES))]


def labelled(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, bad, rates) of every labelled row of ``counted`` that the base rule passes; key is the hash of doc_id."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    one = counted.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*COUNTS, *MORE)).alias("r"))
    rows = one.join(known, "doc_id").select(F.xxhash64("doc_id").alias("key"), (F.col("quality").cast("double") <= 0).alias("bad"), "r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _matrix(batch, COUNTS + MORE)
            passed = ~base_failed(counts)
            x = rates(counts[passed])
            own = batch.select(["key", "bad"]).filter(pa.array(passed))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x[:, k]) for k in range(len(_RATES)))], ["key", "bad", *_RATES])

    return rows.mapInArrow(run, "key long, bad boolean, " + ", ".join(f"{c} double" for c in _RATES))


def samples(rows: DataFrame, good: int, size: int, trees: int = TREES) -> tuple[list[np.ndarray], np.ndarray]:
    """For each tree ``size`` of the ``good`` rows not bad in ``rows`` (``labelled``), and the greatest of their ``draws``."""
    share = (size + 8 * size**0.5) / good
    while True:
        bound = np.uint64(min(2**64 - 1, int(share * 2**64)))

        def run(batches: Iterator[pa.RecordBatch], bound=bound) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, x = batch.column(0).to_numpy(), _matrix(batch, _RATES)
                for k in range(trees):
                    drawn = draws(keys, k)
                    at = np.flatnonzero(drawn <= bound)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(drawn[at].view(np.int64)), *(pa.array(x[at, j]) for j in range(x.shape[1]))], ["tree", "drawn", *_RATES])

        found = rows.where("NOT bad").select("key", *_RATES).mapInArrow(run, "tree long, drawn long, " + ", ".join(f"{c} double" for c in _RATES)).toArrow()
        tree, drawn = found["tree"].to_numpy(), found["drawn"].to_numpy().view(np.uint64)
        if share >= 1 or np.bincount(tree, minlength=trees).min() >= size:
            break
        share *= 2  # a tree got too few
    x = np.stack([found[c].to_numpy() for c in _RATES], axis=1)
    order = np.lexsort((drawn, tree))
    first = np.searchsorted(tree[order], np.arange(trees))
    chosen = [order[f : f + size] for f in first]
    return [x[at] for at in chosen], np.array([drawn[at[-1]] for at in chosen])


def fit(counted: DataFrame, labels: DataFrame) -> Model:
    """Forest and threshold from every labelled row of ``counted`` (``measured``)."""
    rows = materialize(labelled(counted, labels), "labelled")
    seen = rows.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in _RATES)).first()
    if not seen.bad or not seen.good:
        return Model(None, 2.0)
    size = min(seen.good, SAMPLE, max(2, (seen.good + 1) // 2))
    drawn, last = samples(rows, seen.good, size)
    forest = Forest.fit(drawn, *(np.array([seen[f"{f}_{c}"] for c in _RATES]) for f in ("min", "max")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bad = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            score = forest.score(_matrix(batch, _RATES), lambda k: bad | (draws(keys, k) > last[k]))
            yield pa.RecordBatch.from_arrays([pa.array(score), batch.column(1)], ["score", "bad"])

    return Model(forest, threshold(rows.mapInArrow(run, "score double, bad boolean"), seen.bad, seen.good))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """``fit`` on the counts of ``docs``, taken where the texts are."""
    return fit(measured(docs.where("doc_id IS NOT NULL").select("doc_id", "text")), labels)


def _verdict(counts: np.ndarray, model: Model) -> list[pa.Array]:
    score, odd = model.rejects(counts)
    failed = base_failed(counts)
    return [pa.array(score), pa.array(failed), pa.array(~failed & ~odd)]


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus COUNTS, anomaly double, base_failed boolean and kept boolean."""
    docs = without(docs, RESULT)
    names = [*COUNTS, "anomaly", "base_failed", "kept"]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in blocks(batches):
            counts = np.array([statistics(t, hashes) for t in batch.column(at).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(counts[:, k]) for k in range(len(COUNTS))), *_verdict(counts, model)], [*batch.schema.names, *names])

    return docs.mapInArrow(run, plus(docs, RESULT))


def judge_counted(counted: DataFrame, model: Model) -> DataFrame:
    """What ``judge`` adds, for documents that are ``measured`` already."""
    names = ["anomaly", "base_failed", "kept"]
    rest = counted.drop(*MORE)
    kept = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(kept)
            yield pa.RecordBatch.from_arrays([*own.columns, *_verdict(_matrix(batch, COUNTS + MORE), model)], [*own.schema.names, *names])

    return counted.mapInArrow(run, plus(rest, "anomaly double, base_failed boolean, kept boolean"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, train(docs, labels))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both the fit and the verdict need the counts of every document: they are taken once
    counted = materialize(measured(documents(spark, sf_dir).select("doc_id", "text")), "counted")
    done = judge_counted(counted, fit(counted, documents(spark, sf_dir, "labels")))
    return done.select("doc_id", *COUNTS, "base_failed", "kept", F.round("anomaly", 6).alias("anomaly"))
