"""Unigram vocabulary by expectation maximisation (Kudo, 2018).

Seeds are the alphabet and the frequent substrings with the greatest count times length. Each round computes
expected token counts over all segmentations of each distinct pretoken (forward-backward, in the tasks; the
counts are summed by Spark), re-estimates, and prunes the tokens whose loss would cost least.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import ALPHABET
from tokenloom.operators.counting import candidate_counts


def _expected(word: str, logp: dict[str, float], longest: int) -> dict[str, float]:
    n = len(word)
    ahead = [float("-inf")] * (n + 1)
    ahead[0] = 0.0
    spans = []
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > float("-inf") else max(a, b)
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            p = logp.get(word[start:end])
            if p is not None and ahead[start] > float("-inf"):
                spans.append((start, end, p))
                ahead[end] = add(ahead[end], ahead[start] + p)
    back = [float("-inf")] * (n + 1)
    back[n] = 0.0
    for start, end, p in reversed(spans):
        back[start] = add(back[start], p + back[end])
    out: dict[str, float] = defaultdict(float)
    if ahead[n] > float("-inf"):
        for start, end, p in spans:
            if back[end] > float("-inf"):
                out[word[start:end]] += math.exp(ahead[start] + p + back[end] - ahead[n])
    return out


class Expected:
    """``_expected`` for many words at once: words of one length are arrays, tokens are found by a hash of their characters."""

    _FACTOR, _WORDS, _CELLS = np.uint64(0x9E3779B97F4A7C15), 50_000, 1_000_000

    def __init__(self, logp: dict[str, float]):
        self.tokens = [t for t in logp if t]
        self.logp = np.array([logp[t] for t in self.tokens])
        self.longest = max(map(len, self.tokens), default=1)
        self.tables = {}
        of: dict[int, list[int]] = defaultdict(list)
        for i, t in enumerate(self.tokens):
            of[len(t)].append(i)
        for size, ids in of.items():
            codes = _codes([self.tokens[i] for i in ids], size)
            h = np.zeros(len(ids), np.uint64)
            for k in range(size):
                h = h * self._FACTOR + codes[:, k] + np.uint64(1)
            order = np.argsort(h, kind="stable")
            self.tables[size] = h[order], np.array(ids)[order], codes[order]

    def of(self, words: list[str], freq: np.ndarray) -> np.ndarray:
        """Expected count of each token over the words."""
        total, size = np.zeros(len(self.tokens)), np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            n = int(size[own[0]]) if len(own) else 0
            step = max(1, self._CELLS // max(1, n * min(n, self.longest)))
            for at in range(0, len(own) if n else 0, step):
                part = own[at : at + step]
                self._add(total, _codes([words[i] for i in part], n), freq[part])
        return total

    def _add(self, total: np.ndarray, codes: np.ndarray, freq: np.ndarray) -> None:
        rows, n = codes.shape
        wide = min(n, self.longest)
        ids = np.full((n, wide, rows), -1, np.int64)  # by start and length
        for start in range(n):
            h = np.zeros(rows, np.uint64)
            for k in range(1, min(wide, n - start) + 1):
                h = h * self._FACTOR + codes[:, start + k - 1] + np.uint64(1)
                if k in self.tables:
                    keys, numbers, letters = self.tables[k]
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = np.flatnonzero(keys[at] == h)
                    hit = hit[(letters[at[hit]] == codes[hit, start : start + k]).all(1)]
                    ids[start, k - 1, hit] = numbers[at[hit]]
        price = np.where(ids >= 0, self.logp[np.maximum(ids, 0)], -np.inf)
        ahead, back = np.full((n + 1, rows), -np.inf), np.full((n + 1, rows), -np.inf)
        ahead[0] = back[n] = 0
        for end in range(1, n + 1):
            ks = np.arange(1, min(wide, end) + 1)
            ahead[end] = _log_sum(ahead[end - ks] + price[end - ks, ks - 1])
        for start in range(n - 1, -1, -1):
            ks = np.arange(1, min(wide, n - start) + 1)
            back[start] = _log_sum(price[start, ks - 1] + back[start + ks])
        able = np.isfinite(ahead[n])
        for start in range(n):
            k = min(wide, n - start)
            share = ahead[start] + price[start, :k] + back[start + 1 : start + k + 1] - np.where(able, ahead[n], 0)
            there = (ids[start, :k] >= 0) & able & np.isfinite(share)
            total += np.bincount(ids[start, :k][there], (np.exp(np.where(there, share, 0)) * freq)[there], len(total))


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64)


def _log_sum(x: np.ndarray) -> np.ndarray:
    most = x.max(0)
    safe = np.where(np.isfinite(most), most, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe).sum(0))


def expected_counts(counts: DataFrame, logp: dict[str, float]) -> DataFrame:
    """(token, expected) over all pretokens; partial sums leave each task."""
    shared = counts.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Expected(shared.value)
        total, words, freq = np.zeros(len(made.tokens)), [], []
        for batch in batches:
            words += batch.column(0).to_pylist()
            freq.append(batch.column(1).to_numpy(zero_copy_only=False))
            if len(words) >= made._WORDS:
                total += made.of(words, np.concatenate(freq))
                words, freq = [], []
        if words:
            total += made.of(words, np.concatenate(freq))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([made.tokens[i] for i in there], pa.string()), pa.array(total[there])], ["token", "expected"])

    return counts.select("pretoken", "frequency").mapInArrow(run, "token string, expected double").groupBy("token").agg(F.sum("expected").alias("expected"))


def train(counts: DataFrame, size: int, specials: list[str] = (), seeds: int = 20_000, most: int = 16, keep: float = 0.75, rounds: int = 2) -> list[tuple[str, float]]:
    """Tokens with log probabilities, specials first (at 0), then by probability. At most ``seeds`` candidates start."""
    room = size - len(specials)
    if room < len(ALPHABET):
        raise ValueError("the vocabulary must hold the alphabet")
    seed = candidate_counts(counts, 1, most).orderBy(F.desc(F.col("count") * F.length("token")), "token").limit(seeds).collect()
    start: dict[str, float] = {r["token"]: float(r["count"]) for r in seed}
    for c in ALPHABET:
        start.setdefault(c, 1.0)
    letters = set(ALPHABET)
    total = sum(start.values())
    logp = {t: math.log(c / total) for t, c in start.items()}
    while True:
        for _ in range(rounds):
            found = {r.token: r.expected for r in expected_counts(counts, logp).collect()}  # a row a token
            live = {t: max(found.get(t, 0.0), 1e-3 if t in letters else 0.0) for t in logp}
            live = {t: c for t, c in live.items() if t in letters or c >= 0.5}
            total = sum(live.values())
            logp = {t: math.log(c / total) for t, c in live.items()}
        if len(logp) <= room:
            break
        goal = max(room, int(len(logp) * keep))
        # a token's use times what spelling it from others would cost more
        worth = {}
        for t, c in live.items():
            if t not in letters:
                rest = {k: logp[k] for i in range(len(t)) for j in range(i + 1, len(t) + 1) if (k := t[i:j]) != t and k in logp}
                worth[t] = c * (logp[t] - _best(t, rest))
        kept = sorted(worth, key=lambda t: (-worth[t], t))[: goal - len(letters)]
        logp = {t: logp[t] for t in [*letters, *kept]}
    rest = sorted(logp.items(), key=lambda x: (-x[1], x[0]))
    return [*((s, 0.0) for s in specials), *rest]


def _best(word: str, logp: dict[str, float]) -> float:
    best = [0.0] + [float("-inf")] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            p = logp.get(word[start:end])
            if p is not None:
                best[end] = max(best[end], best[start] + p)
    return best[-1]
