"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each has a linear (logistic) model over term rates of the
text; later models also get the log-odds of all earlier categories. In training those come out of fold:
every labelled row's earlier predictions are made by models that have not seen it, so a later model
learns how far earlier ones can be trusted.

Terms are the words of a text (letters only, lower case) and their prefixes of 3 to 7 letters, which find
the inflected and compound forms; a term is named by one of 2^21 hash buckets. A term's value is 50 * occurrences / (words + 20). For each category
the ``terms`` terms that tell it apart best (by log-likelihood ratio over labelled rows) get weights.

The models are fitted on a bounded sample: the ``most`` labelled rows first in hash order of doc_id
(``MOST_LABELLED``), by one task, so that only the fitted models reach the driver. All documents are scored, each as a whole; scoring needs one pass and no shuffle: a
word's weights in all models are summed once and remembered.

The label table gives two labels. The chain's categories are: low_quality; one category toxic_<lang> for
each language among the labelled toxic rows of the sample, if there are several; toxic. A document is toxic if its last probability is
at least the threshold that gives the best F1 on out-of-fold predictions.

Null or empty texts have the prior probabilities and count as not toxic. Rows with null doc_id or null
labels aren't used for fitting; of a doc_id with several texts one is, the first in hash order; where a doc_id is labelled twice, the first by label order counts. With
no usable labels, or none positive, all probabilities are 0 and nothing is toxic. Extra columns stay, except that one
with the name of a result column is replaced.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm._common import blocks, documents, plus, without

MOST_LABELLED = 4000
TERMS = 160
LEAST_ROWS = 3
BUCKETS = 1 << 21
FOLDS = 5
SHORTEST, LONGEST = 3, 7
SCALE, SMOOTH = 50.0, 20.0

_WORD = regex.compile(r"\p{L}+")


def terms_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the unpenalised intercept."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1).astype(np.float64)
    w = np.zeros(x.shape[1])
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
    w[-1] = np.log(rate / (1 - rate))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    loss = np.inf
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        now = -np.sum(np.log(np.where(y > 0, p, 1 - p) + 1e-12)) + 0.5 * np.sum(penalty * w * w)
        if loss - now < 1e-4 * max(1.0, abs(now)) and np.isfinite(loss):
            break
        loss = now
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x
        h[np.diag_indices_from(h)] += penalty
        w = w - np.linalg.solve(h, x.T @ (p - y) + penalty * w)
    return w


@dataclass
class Link:
    """One model of the chain: term weights, weights of the earlier categories' log-odds, intercept."""

    name: str
    terms: dict[int, float] = field(default_factory=dict)
    earlier: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -30.0


@dataclass
class Chain:
    links: list[Link]
    threshold: float

    @property
    def names(self) -> list[str]:
        return [link.name for link in self.links]

    def word_weights(self, word: str) -> tuple[float, ...]:
        terms = [_bucket(t) for t in terms_of(word)]
        return tuple(sum(link.terms.get(t, 0.0) for t in terms) for link in self.links)

    def probabilities(self, sums: np.ndarray, words: np.ndarray) -> np.ndarray:
        """(documents x categories); ``sums`` are summed word weights, ``words`` word counts."""
        logits = np.zeros_like(sums)
        for k, link in enumerate(self.links):
            logits[:, k] = np.clip(link.bias + SCALE * sums[:, k] / (words + SMOOTH) + logits[:, :k] @ link.earlier, -12, 12)
        return _sigmoid(logits)


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) & (BUCKETS - 1)


class Terms(dict):
    """Term buckets by word, remembered; forgets everything when it has grown to ``most`` words."""

    most = 100_000

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = np.array([_bucket(t) for t in terms_of(word)], np.int32)
        return found


def term_counts(text: str | None, known: Terms) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct term buckets of a text, their counts, and its words."""
    words = _words(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), 0
    found, times = np.unique(np.concatenate(list(map(known.__getitem__, words))), return_counts=True)
    return found, times, len(words)


def _best_terms(rows, cols, size: int, y: np.ndarray, use: np.ndarray, most: int) -> np.ndarray:
    """Terms with the greatest log-likelihood ratio between rows in and out of the category."""
    inside = np.bincount(cols[(use & (y > 0))[rows]], minlength=size).astype(float)
    outside = np.bincount(cols[(use & (y <= 0))[rows]], minlength=size).astype(float)
    n1, n0 = max(1.0, (use & (y > 0)).sum()), max(1.0, (use & (y <= 0)).sum())
    both = (inside + outside) / (n1 + n0)

    def part(k, n):
        p = k / n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(p / both), 0) + np.where(n > k, (n - k) * np.log((1 - p) / (1 - both)), 0)

    gain = np.nan_to_num(part(inside, n1) + part(outside, n0), posinf=0, neginf=0)
    gain[inside + outside < LEAST_ROWS] = 0
    # a term in favour of the category is worth more than one against it
    gain[inside / n1 < outside / n0] *= 0.25
    best = np.argsort(-gain, kind="stable")[:most]
    return best[gain[best] > 0]


def _columns(rows, cols, values, chosen: np.ndarray, size: int, n: int) -> np.ndarray:
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    at = place[cols] >= 0
    x = np.zeros((n, len(chosen)), np.float32)
    x[rows[at], place[cols[at]]] = values[at]
    return x


def _table(texts: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the terms that ``LEAST_ROWS`` texts hold, and each column's term; others are never among the best."""
    held = np.zeros(BUCKETS, np.int32)
    for terms, _, _ in texts:
        held[terms] += 1  # a text's terms are distinct
    common = np.flatnonzero(held >= LEAST_ROWS)
    place = np.full(BUCKETS, -1, np.int32)
    place[common] = np.arange(len(common), dtype=np.int32)
    n = int(held[common].sum())
    rows, cols, values, at = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n, np.float32), 0
    for i, (terms, times, words) in enumerate(texts):
        own = place[terms]
        found = own >= 0
        part = slice(at, at := at + int(np.count_nonzero(found)))
        rows[part], cols[part] = i, own[found]
        values[part] = times[found].astype(np.float32) * (np.float32(SCALE) / (np.float32(words) + np.float32(SMOOTH)))
    return rows, cols, values, common


def fit_chain(texts: list[tuple[np.ndarray, np.ndarray, int]], labels: dict[str, np.ndarray], folds: np.ndarray, terms: int = TERMS) -> Chain:
    """Fit one link for each label, in order; the last one is the verdict. ``texts``: their ``term_counts``."""
    n = len(texts)
    links = [Link(name, earlier=np.zeros(k)) for k, name in enumerate(labels)]
    verdict = list(labels.values())[-1]
    if not n or not verdict.any() or verdict.all():
        return Chain(links, 1.1)
    rows, cols, values, common = _table(texts)
    size = len(common)
    out = np.zeros((n, len(links)))
    for k, (link, y) in enumerate(zip(links, labels.values())):
        y = y.astype(float)

        def fit(use, k=k, y=y):
            chosen = _best_terms(rows, cols, size, y, use, terms)
            x = np.concatenate((_columns(rows, cols, values, chosen, size, n), out[:, :k]), axis=1)
            return chosen, fit_logistic(x[use], y[use]), x

        for f in np.unique(folds):
            use = folds != f
            if use.any():
                _, w, x = fit(use)
                out[~use, k] = np.clip(x[~use] @ w[:-1] + w[-1], -12, 12)
        chosen, w, _ = fit(np.ones(n, bool))
        link.terms = {int(c): float(v) for c, v in zip(common[chosen], w)}
        link.earlier, link.bias = w[len(chosen) : -1], float(w[-1])
    p = _sigmoid(out[:, -1])
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(verdict[order] > 0)
    f1 = 2 * hits / (np.arange(1, n + 1) + verdict.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = 0
    best = int(np.argmax(f1))
    below = p[order][best + 1] if best + 1 < n else 0.0
    return Chain(links, float((p[order][best] + below) / 2))


def _order() -> list:
    return [F.xxhash64("doc_id"), F.col("doc_id")]


def sampled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """The bounded training sample, at most ``most`` rows: labels, lang, terms, times (four bytes each), words.

    Terms are counted where the texts are. Of a doc_id with several texts the first in hash order counts.
    """
    sample = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("toxic", "quality")).alias("l")).select("doc_id", F.col("l.toxic").cast("long").alias("toxic"), F.col("l.quality").cast("long").alias("quality")).orderBy(*_order()).limit(most)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    text = docs.where("doc_id IS NOT NULL").select("doc_id", "text", lang.alias("lang")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        for batch in blocks(batches):
            found = [term_counts(t, known) for t in batch.column(1).to_pylist()]
            packed = [pa.array([f[k].astype(np.int32).tobytes() for f in found], pa.binary()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *packed, pa.array([f[2] for f in found], pa.int64())], ["doc_id", *batch.schema.names[2:], "terms", "times", "words"])

    rows = text.select("doc_id", "text", "lang", "toxic", "quality", F.xxhash64("text").alias("hash")).mapInArrow(run, "doc_id long, lang string, toxic long, quality long, hash long, terms binary, times binary, words long")
    first = rows.groupBy("doc_id").agg(F.min_by(F.struct("lang", "toxic", "quality", "terms", "times", "words"), F.struct("hash", "lang")).alias("r"))
    return first.select("doc_id", "r.*")


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list:
    """The rows of ``sampled`` in hash order of doc_id."""
    return sampled(docs, labels, most).orderBy(*_order()).collect()


def _fitted(rows: list) -> Chain:
    """The chain for rows as ``labelled`` gives them."""
    toxic = np.array([r.toxic for r in rows], np.int64) > 0
    langs = sorted({r.lang for r in rows if r.toxic > 0 and r.lang})
    chain = {"low_quality": np.array([r.quality is not None and r.quality <= 0 for r in rows], bool)}
    for lang in langs if len(langs) > 1 else []:
        chain[f"toxic_{lang}"] = toxic & np.array([r.lang == lang for r in rows], bool)
    chain["toxic"] = toxic
    folds = np.array([(r.doc_id * 2654435761 >> 7) % FOLDS for r in rows], np.int64)
    return fit_chain([(np.frombuffer(r.terms, np.int32), np.frombuffer(r.times, np.int32), r.words) for r in rows], chain, folds)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Chain:
    """The chain, fitted by one task: the sample stays out of the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            # binary values stay where they are
            columns = [[x.as_buffer() for x in c] if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns]
            rows += map(Row(*batch.schema.names), *columns)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fitted(rows))], pa.binary())], ["chain"])

    made = sampled(docs, labels, most).repartition(1).sortWithinPartitions(*_order()).mapInArrow(run, "chain binary").collect()
    # a sample known to be empty may run no task
    return pickle.loads(made[0].chain) if made else _fitted([])


RESULT = "p_toxic double, toxic boolean, categories string"


class Weights(dict):
    """Numbers of words: 0 for those without weight, else the row of their weights in all models."""

    most = 300_000

    def __init__(self, chain: Chain):
        super().__init__()
        self.width = len(chain.links)
        self.of_term: dict[int, np.ndarray] = {}
        for k, link in enumerate(chain.links):
            for t, w in link.terms.items():
                self.of_term.setdefault(t, np.zeros(self.width))[k] = w
        self.rows: list[np.ndarray] = [np.zeros(self.width)]

    def __missing__(self, word: str) -> int:
        own = [w for t in terms_of(word) if (w := self.of_term.get(_bucket(t))) is not None]
        self[word] = len(self.rows) if own else 0
        if own:
            self.rows.append(np.sum(own, axis=0))
        return self[word]

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Summed weights (texts x models) and word counts."""
        if len(self) > self.most:
            self.clear()
            del self.rows[1:]
        words = np.zeros(len(texts))
        ids, owners = [], []
        for i, text in enumerate(texts):
            found = _words(text)
            words[i] = len(found)
            own = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
            own = own[own > 0]
            ids.append(own)
            owners.append(np.full(len(own), i))
        at, row = np.concatenate(ids), np.concatenate(owners)
        table = np.array(self.rows)
        return np.stack([np.bincount(row, table[at, k], len(texts)) for k in range(self.width)], axis=1).astype(float), words


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` plus p_toxic double, toxic boolean and categories string (name=probability, ...)."""
    docs = without(docs, RESULT)
    names = chain.names
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(chain)
        for batch in blocks(batches):
            sums, words = weights.sums(batch.column(at).to_pylist())
            p = chain.probabilities(sums, words)
            toxic = (p[:, -1] >= chain.threshold) & (words > 0)
            text = [", ".join(f"{a}={b:.4f}" for a, b in zip(names, row)) for row in p.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p[:, -1]), pa.array(toxic), pa.array(text, pa.string())], [*batch.schema.names, "p_toxic", "toxic", "categories"])

    return docs.mapInArrow(run, plus(docs, RESULT))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = train(docs, documents(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), chain).select("doc_id", F.round("p_toxic", 6).alias("p_toxic"), "toxic", "categories")
