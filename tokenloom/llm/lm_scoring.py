"""Language-model scores by logistic context mixing.

A text is a sequence of words (A-Z lower-cased, runs without ASCII white space) and one end. The model
spells it in bytes, a space after each word and a line feed for the end, and predicts each byte bit by bit:

* predictors keep counts of zeros and ones for hashed contexts: the last one, two, three and four bytes of
  the word with the document's class, the word so far, and the word so far with the class. Bytes before the
  word count as spaces: no context holds anything of the words before but the class. The tables have a
  fixed number of slots, whatever the size of the corpus, and different contexts may share a slot;
* the predictors' log-odds are added with weights (logistic mixing); a gate, made of the bit's place and
  the experience of the two word contexts, selects the weights. Weights are learned online over the words in the order
  of their spelling, not of the texts: each mini-batch is predicted before it changes them. Every partition of the training counts
  learns from the same start and the weights are averaged by its bits;
* a last stage refines the probability by what has really happened, for each predicted level and partial byte;
  it counts along with the online pass;
* the exact count of the whole word in the class takes a share of the probability, as large as it has
  earned: each class's share is learned online, along with the weights. These counts grow with the corpus, however many
  of the spelled contexts share a slot;
* a document's class (its language, say) is a guess from the words before: each word votes, by its hash
  bucket, for clusters of buckets that occur in the same documents. It adapts with every word.

A text is scored in its order: the class follows the words already read. Contexts over several words aren't part of
the model: what a word costs depends on the class and the spelling, which is why it is worked out once for each
distinct pair (see the README for what the other way would cost).

In training an observation is taken out of the counts before it is predicted (as if it were yet to come),
so weights and refinement don't trust contexts that have seen just this word.

The training documents are those whose crc32 of the doc_id's decimal digits isn't 1 modulo 5. Counts of
words by class combine before they are shuffled and grow with the corpus; hashed tables, weights and
clusters have fixed sizes and alone are broadcast. Counts and costs of words are looked up by a join; only
those of the ``HOT`` most frequent words, a bounded number, are broadcast, which spares most rows and all hot
keys.

Result: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte
(-log2 of the score for each byte spelled). Null or empty text: the end alone. A null doc_id counts as a
training document. Rows that repeat a doc_id are scored each. Extra columns are ignored. Without training
documents the counts are 0 and base_score 0 for each token (one unknown word is all there is).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm._common import blocks, documents, materialize, mix

FOLDS, HELD_OUT = 5, 1
BUCKETS, CLUSTERS = 256, 6
PREDICTORS, WORD_PREDICTORS, LONGEST = 6, 2, 4
#: Each predictor's slots as a power of two, and where they begin in the table of all.
SLOT_BITS = (16, 18, 20, 21, 22, 22)
FIRST_SLOT = tuple(sum(1 << b for b in SLOT_BITS[:k]) for k in range(PREDICTORS))
SLOTS = sum(1 << b for b in SLOT_BITS)
SHARD = 1 << 16
ADDED = 64
GATES = 4 * 4 * 8
LEVELS = 24
HOT = 300_000
WORDS_KEPT = 600_000
TEXT_BLOCK = 4 << 20
SPELL_BLOCK, BITS_BLOCK, LEARN_BLOCK = 1 << 20, 1 << 15, 1 << 13
RATE = 0.05
END = b"\n"
SHRINK = np.float32(0.05)


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the words, each followed by its space (the end is a line feed), and where words start."""
    parts = [w if w == END else w + b" " for w in words]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)


_PRIME = 0x100000001B3
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, _PRIME, np.uint64))))
    return _POWERS[0][:n]


def contexts(data: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bytes in their contexts: hashes of the contexts (predictors x distinct, 32 bits), the bytes
    themselves, and for each byte of the words its place among them. Words share their beginnings, and what
    all predictors see of a byte is settled by the class, the word so far and the byte.
    """
    n = len(data)
    lengths = np.diff(np.append(starts, n))
    word = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(n) - starts[word]
    steps = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(steps)))
    prefix = sums[:-1] - sums[starts][word] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    kind = (classes[word].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    del steps, sums, word
    _, first, where = np.unique(mix(prefix + kind) + data * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_inverse=True)
    context = np.empty((PREDICTORS, len(first)), np.uint64)
    whole = np.zeros(len(first), np.uint64)
    kind, at = kind[first], place[first]
    for k in range(1, LONGEST + 1):
        b = np.where(at >= k, data[np.maximum(first - k, 0)], 32).astype(np.uint64)
        whole = (whole << np.uint64(8)) | b
        context[k - 1] = whole + kind
    context[-2] = prefix[first]
    context[-1] = prefix[first] + kind
    context += np.arange(1, PREDICTORS + 1, dtype=np.uint64)[:, None] * np.uint64(0xA0761D6478BD642F)
    return (mix(context) >> np.uint64(32)).astype(np.uint32), data[first], where.reshape(-1)


def partial_bytes(data: np.ndarray) -> np.ndarray:
    """Of each bit, the bits of its byte before it, with a 1 in front."""
    return (data.astype(np.uint32) | np.uint32(256))[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)


def bits_of(data: np.ndarray) -> np.ndarray:
    return ((data[:, None] >> np.arange(7, -1, -1, dtype=np.uint8)) & 1).astype(bool)


def slot(k: int, context: np.ndarray, partial: np.ndarray) -> np.ndarray:
    """Slots of predictor k (bytes x bits), counted from its first."""
    return ((context[k][:, None] + partial * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOT_BITS[k])


def _experience(n: np.ndarray) -> np.ndarray:
    return (n > 0.5).astype(np.uint8) + (n > 3.5) + (n > 30.5)


class Mixer:
    """Weights by gate and refinement counts, with the predictors' tables.

    For learning the tables are counts (``zeros``, ``ones``), for scoring log-odds and experience.
    """

    def __init__(self, zeros: np.ndarray, ones: np.ndarray):
        self.zeros, self.ones = zeros, ones
        self.weights = np.full((GATES, PREDICTORS), 0.3, np.float32)
        self.power = np.zeros((GATES, PREDICTORS))
        self.refine = np.zeros((2, 256 * LEVELS))
        # by class: training tokens, and how often the exact count or the spelling was right
        self.tokens, self.trust = np.zeros(CLUSTERS + 1), np.ones((2, CLUSTERS + 1))
        self.stretch = self.seen = None

    def prepare(self) -> None:
        """Work out log-odds and experience of every slot and let go of the counts."""
        self.stretch = np.log((self.ones + SHRINK) / (self.zeros + SHRINK))
        at = FIRST_SLOT[PREDICTORS - WORD_PREDICTORS]
        self.seen = _experience(self.ones[at:] + self.zeros[at:])
        self.zeros = self.ones = None

    def inputs(self, context: np.ndarray, partial: np.ndarray, leave_out: np.ndarray | None = None):
        """Log-odds (a list by predictor, bytes x bits) and gates. leave_out: bits to take out."""
        odds, gate = [], 0
        if leave_out is not None:
            one = leave_out.astype(np.float32)
            zero = 1 - one
        for k in range(PREDICTORS):
            at = slot(k, context, partial).astype(np.intp) + FIRST_SLOT[k]
            word = k >= PREDICTORS - WORD_PREDICTORS
            if leave_out is None:
                odds.append(self.stretch.take(at))
                if word:
                    gate = gate * 4 + self.seen.take(at - FIRST_SLOT[PREDICTORS - WORD_PREDICTORS])
            else:
                n1, n0 = self.ones[at], self.zeros[at]
                n1 -= one
                n0 -= zero
                np.maximum(n1, 0, out=n1)
                np.maximum(n0, 0, out=n0)
                if word:
                    gate = gate * 4 + _experience(n0 + n1)
                n1 += SHRINK
                n0 += SHRINK
                n1 /= n0
                odds.append(np.log(n1, out=n1))
        return odds, gate.astype(np.intp) * 8 + np.arange(8)

    def mixed(self, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z, weights = np.zeros(gate.shape, np.float32), np.ascontiguousarray(self.weights.T)
        for k in range(PREDICTORS):
            z += odds[k] * weights[k].take(gate)
        return np.clip(z, -14, 14)

    @staticmethod
    def cell(z: np.ndarray, partial: np.ndarray) -> np.ndarray:
        level = np.clip((z + 12) * np.float32(LEVELS / 24), 0, LEVELS - 1).astype(np.int32)
        return partial.astype(np.int32) * LEVELS + level

    def counted(self, classes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The part of the probability that a word seen ``n`` times in its class has from its exact count."""
        trust = self.trust[0] / self.trust.sum(0)
        return trust[classes] * n / np.maximum(self.tokens, 1)[classes]

    def spelled_share(self, classes: np.ndarray) -> np.ndarray:
        # a class without training tokens is spelled
        return np.where(self.tokens > 0, self.trust[1] / self.trust.sum(0), 1)[classes]

    def word_log10(self, words: list[bytes], classes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 of the probability of each word, seen ``n`` times in its class."""
        cost, share = self.log10(words, classes), self.spelled_share(classes)
        # a spelling too unlikely for a double counts by itself
        p = np.log10(self.counted(classes, n) + share * 10.0 ** np.maximum(cost, -300))
        return np.where(cost > -300, p, np.maximum(p, cost + np.log10(share)))

    def log10(self, words: list[bytes], classes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each word's spelling under its class."""
        data, starts = spelled(words)
        context, byte, where = contexts(data, starts, classes)
        cost = np.empty(len(byte))
        for i in range(0, len(byte), BITS_BLOCK):
            part = slice(i, i + BITS_BLOCK)
            partial = partial_bytes(byte[part])
            z = self.mixed(*self.inputs(context[:, part], partial))
            p = 1 / (1 + np.exp(-z.astype(float)))
            at = self.cell(z, partial)
            n0, n1 = self.refine[0][at], self.refine[1][at]
            p = 0.5 * (p + (n1 + 20 * p) / (n0 + n1 + 20))
            cost[part] = np.log10(np.where(bits_of(byte[part]), p, 1 - p)).sum(1)
        return np.add.reduceat(cost[where], starts)

    def learn(self, words: list[bytes], classes: np.ndarray, n: np.ndarray) -> int:
        """Predict in mini-batches; after each, adapt refinement counts and weights (AdaGrad). Bits seen."""
        data, starts = spelled(words)
        context, byte, where = contexts(data, starts, classes)
        each = np.bincount(where, np.repeat(n.astype(float), np.diff(np.append(starts, len(data)))), len(byte))
        cost = np.zeros(len(byte))
        for at in range(0, len(byte), LEARN_BLOCK):
            part = slice(at, at + LEARN_BLOCK)
            cost[part] = self._adapt(context[:, part], byte[part], each[part])
        if self.tokens.any():
            # this word's own occurrence is left out on both sides
            counted = self.counted(classes, n - 1)
            other = self.spelled_share(classes) * 10.0 ** np.maximum(np.add.reduceat(cost[where], starts), -300)
            right = counted / np.maximum(counted + other, 1e-300)
            for k, x in enumerate((right, 1 - right)):
                self.trust[k] += np.bincount(classes, n * x, CLUSTERS + 1)
        return byte.size * 8

    def _adapt(self, context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Learn from bytes seen ``n`` times each; gives the log10 probability that each had before."""
        bits, partial = bits_of(byte), partial_bytes(byte)
        odds, gate = self.inputs(context, partial, bits)
        z = self.mixed(odds, gate)
        times = np.repeat(n, 8)
        at = self.cell(z, partial).reshape(-1) + bits.reshape(-1) * (256 * LEVELS)
        self.refine += np.bincount(at, times, 2 * 256 * LEVELS).reshape(2, -1)
        p = 1 / (1 + np.exp(-z))
        error = (bits - p).reshape(-1) * times
        g = gate.reshape(-1)
        weight = np.maximum(np.bincount(g, times, GATES), 1e-9)
        for k in range(PREDICTORS):
            slope = np.bincount(g, error * odds[k].reshape(-1), GATES) / weight
            self.power[:, k] += slope * slope
            self.weights[:, k] += (RATE * slope / np.sqrt(self.power[:, k] + 1e-8)).astype(np.float32)
        return np.log10(np.where(bits, p, 1 - p)).sum(1)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 130_000) -> Iterator[pa.Table]:
    """Batches together to at least ``rows`` rows, so that more words share their beginnings."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def spell_blocks(words: list[bytes], limit: int = SPELL_BLOCK) -> Iterator[slice]:
    """Slices of words of about ``limit`` bytes."""
    at = total = 0
    for i, w in enumerate(words):
        if total and total + len(w) + 1 > limit:
            yield slice(at, i)
            at, total = i, 0
        total += len(w) + 1
    if words:
        yield slice(at, len(words))


def byte_list(words: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """What ``to_pylist`` gives for binary values without nulls, in a third of the time."""
    if isinstance(words, pa.ChunkedArray):
        return [w for chunk in words.chunks for w in byte_list(chunk)]
    if not len(words):
        return []
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    first, last = int(ends[0]), int(ends[-1])
    data = words.buffers()[2].slice(first, last - first).to_pybytes() if last > first else b""
    ends = (ends - first).tolist()
    return [data[i:j] for i, j in zip(ends, ends[1:])]


def hash_buckets(words: list[bytes]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(BUCKETS)).astype(np.int64)


class Vocabulary(dict):
    """Numbers of words as they come; ``words`` by number, with the hash bucket of each."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []
        self._made = np.zeros(0, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words; those not known yet get the next ones."""
        number = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        new = number < 0
        fresh, n = list(compress(words, new.tolist())), len(self.words)
        number[new] = np.arange(n, n + len(fresh))
        self.update(zip(fresh, range(n, n + len(fresh))))
        self.words += fresh
        return number

    @property
    def buckets(self) -> np.ndarray:
        """Hash buckets by word number."""
        if len(self._made) < len(self.words):
            self._made = np.concatenate((self._made, hash_buckets(self.words[len(self._made) :])))
        return self._made


def _split(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of the texts, the place of each word among them, and the texts' lengths in words."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    n = np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, 1)
    lists = pc.ascii_split_whitespace(texts)
    lengths = pc.list_value_length(lists).to_numpy() * n
    words = pc.list_flatten(lists)
    # an empty text splits into one empty word, which no other text holds
    coded = words.filter(pc.not_equal(words, "")).dictionary_encode()
    return byte_list(coded.dictionary.cast(pa.binary())), coded.indices.to_numpy(), lengths


def _with_ends(values: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' values with ``end`` behind each text's, and where texts start."""
    starts = (np.cumsum(lengths + 1) - (lengths + 1)).astype(np.int64)
    out = np.full(int(lengths.sum()) + len(lengths), end, np.int64)
    at = np.ones(len(out), bool)
    at[starts + lengths] = False
    out[at] = values
    return out, starts


def tokenized(texts: pa.Array, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each with its end, and where texts start."""
    words, place, lengths = _split(texts)
    return _with_ends(known.numbers(words)[place], lengths, known.numbers([END])[0])


def bucketed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the words of all texts, each with its end, and where texts start."""
    words, place, lengths = _split(texts)
    return _with_ends(hash_buckets(words)[place], lengths, hash_buckets([END])[0])


def causal_classes(buckets: np.ndarray, starts: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Class of each token from the votes of those before it in its text; CLUSTERS: none yet."""
    n = len(buckets)
    # whole numbers, so that a text's classes don't depend on the texts before it; one row a cluster
    sums = np.zeros((CLUSTERS, n + 1), np.int64)
    length = np.diff(np.append(starts, n))
    best = out = None
    for k in range(CLUSTERS):
        np.cumsum(np.round(votes[:, k] * 1e6).astype(np.int64)[buckets], out=sums[k, 1:])
        own = sums[k, :-1] - np.repeat(sums[k, starts], length)
        if best is None:
            best, out = own, np.zeros(n, np.uint8)
        else:
            out[own > best] = k
            np.maximum(best, own, out=best)
    out[starts] = CLUSTERS
    return out


def clusters(together: np.ndarray) -> np.ndarray:
    """Votes (buckets x clusters), log-odds by which a bucket speaks for a cluster, from co-occurrence."""
    total = together.sum()
    if not total:
        return np.zeros((BUCKETS, CLUSTERS))
    mass = together.sum(1)
    x = np.log((together + 1) * total / (np.outer(mass, mass) + total))
    x -= np.average(x, axis=0, weights=mass)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centres = [x[int(np.argmax(mass))]]
    while len(centres) < CLUSTERS:
        far = np.min([1 - x @ c for c in centres], axis=0) * np.sqrt(mass)
        centres.append(x[int(np.argmax(far))])
    centres = np.array(centres)
    for _ in range(30):
        own = np.argmax(x @ centres.T, axis=1)
        for k in range(CLUSTERS):
            if (own == k).any():
                c = np.average(x[own == k], axis=0, weights=mass[own == k] + 1e-9)
                centres[k] = c / (np.linalg.norm(c) + 1e-9)
    share = np.stack([together[own == k].sum(0) + 1 for k in range(CLUSTERS)], axis=1)
    votes = np.log(share / share.sum(0))
    return np.round(votes - votes.mean(1, keepdims=True), 6)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def co_occurrence(docs: DataFrame) -> np.ndarray:
    """Sum over documents of the outer product of the square roots of their bucket counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, BUCKETS))
        for batch in blocks(batches, limit=TEXT_BLOCK):
            found, starts = bucketed(batch.column(0))
            own = found + BUCKETS * np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(found))))
            counts = np.sqrt(np.bincount(own, minlength=BUCKETS * len(starts)).reshape(-1, BUCKETS))
            total += counts.T @ counts
        # whole numbers: sums don't depend on their order
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(BUCKETS, dtype=np.int32), 1)), pa.array([r.tobytes() for r in np.round(total * 1024).astype(np.int64)], pa.binary())], ["row", "cells"])

    def add(rows: pa.Table) -> pa.Table:
        cells = np.sum([np.frombuffer(b, np.int64) for b in rows["cells"].to_pylist()], axis=0)
        return pa.table({"row": rows["row"].slice(0, 1), "cells": pa.array([cells.tobytes()], pa.binary())})

    part = docs.select("text").mapInArrow(run, "row int, cells binary")
    # two levels, so that no task adds up more than its share of partial rows
    half = part.groupBy("row", F.pmod(F.xxhash64("cells"), F.lit(16)).alias("salt")).applyInArrow(lambda t: add(t.select(["row", "cells"])), "row int, cells binary")
    out = np.zeros((BUCKETS, BUCKETS))
    for r in half.groupBy("row").applyInArrow(add, "row int, cells binary").collect():
        out[r.row] = np.frombuffer(r.cells, np.int64) / 1024
    return out


def word_counts(docs: DataFrame, votes: np.ndarray) -> DataFrame:
    """(word, class, n) over documents (text, held_out); n counts training documents only and may be 0.

    Counts combine in each task and again after one shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        # how often in training, and whether at all
        counts, there = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(there)
            word, kind = np.divmod(at, CLUSTERS + 1)
            return pa.RecordBatch.from_arrays([pa.array([known.words[i] for i in word.tolist()], pa.binary()), pa.array(kind.astype(np.int32)), pa.array(counts[at])], ["word", "class", "n"])

        for batch in blocks(batches, limit=TEXT_BLOCK):
            numbers, starts = tokenized(batch.column(0), known)
            kind = causal_classes(known.buckets[numbers], starts, votes)
            held = np.repeat(np.array(batch.column(1).to_pylist(), bool), np.diff(np.append(starts, len(numbers))))
            wide = len(known) * (CLUSTERS + 1)
            if wide > len(counts):
                more = wide // 2 + wide - len(counts)
                counts, there = (np.concatenate((x, np.zeros(more, x.dtype))) for x in (counts, there))
            at = numbers * (CLUSTERS + 1) + kind
            there[at] = True
            np.add.at(counts, at, (~held).astype(np.int64))
            if len(known) > WORDS_KEPT:
                yield out()
                known, counts, there = Vocabulary(), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)
        yield out()

    return docs.select("text", "held_out").mapInArrow(run, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


def tallies(batches: Iterator[pa.RecordBatch], most: int = 2**31 - 1) -> Iterator[tuple[int, np.ndarray]]:
    """Zeros and ones by slot, side by side, of batches (word, class, n), as shards to add up: number and cells.

    The table holds 32-bit numbers and is given out before one could pass ``most``; it is wide where a single block could.
    """
    table, total = np.zeros(2 * SLOTS, np.int32), 0

    def shards() -> Iterator[tuple[int, np.ndarray]]:
        for k, shard in enumerate(table.reshape(-1, 2 * SHARD)):
            if shard.any():
                yield k, shard.astype(np.int64)

    for batch in gathered(batches):
        words, kind, n = byte_list(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for part in spell_blocks(words):
            data, starts = spelled(words[part])
            lengths = np.diff(np.append(starts, len(data)))
            context, byte, where = contexts(data, starts, kind[part])
            each = np.bincount(where, np.repeat(n[part].astype(float), lengths), len(byte))
            more = int((n[part] * lengths).sum())
            if total + more > most:
                if total:
                    yield from shards()
                table, total = np.zeros(2 * SLOTS, np.int32 if more <= most else np.int64), 0
            total += more
            for i in range(0, len(byte), BITS_BLOCK):
                part = slice(i, i + BITS_BLOCK)
                partial, bits = partial_bytes(byte[part]), bits_of(byte[part])
                times = np.repeat(each[part].astype(table.dtype), 8)
                for k in range(PREDICTORS):
                    at = (slot(k, context[:, part], partial) * np.uint32(2) + bits).reshape(-1)
                    np.add.at(table[2 * FIRST_SLOT[k] :], at.astype(np.int64), times)
    yield from shards()


def hashed_tables(counts: DataFrame) -> np.ndarray:
    """Zeros and ones of all slots, side by side (slots x 2), so that one look into memory finds both. Each task makes a partial table; those of ADDED tasks are added up at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, cells in tallies(batches):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())], ["shard", "cells"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(SHARD * 2, np.int64)
        for b in rows["cells"]:
            total += np.frombuffer(zlib.decompress(b.as_py()), np.int64)
        return pa.table({"shard": rows["shard"].slice(0, 1), "cells": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    made = counts.select("word", "class", "n").mapInArrow(run, "shard int, cells binary")
    made = made.groupBy("shard", F.floor(F.spark_partition_id() / ADDED).alias("tasks")).applyInArrow(lambda t: add(t.select(["shard", "cells"])), "shard int, cells binary")
    both = np.zeros((SLOTS, 2), np.float32)
    for r in made.groupBy("shard").applyInArrow(add, "shard int, cells binary").toLocalIterator():
        both[r.shard * SHARD : (r.shard + 1) * SHARD] = np.frombuffer(zlib.decompress(r.cells), np.int64).reshape(-1, 2)
    return both


def train(counts: DataFrame) -> Mixer:
    """Tables, then weights and refinement: learned online in each partition, averaged and added."""
    spark = counts.sparkSession
    counts = counts.where("n > 0").select("word", "class", "n")
    both = hashed_tables(counts)
    mixer = Mixer(*both.T)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        mixer.tokens[r["class"]] = r.n
    tables, tokens = spark.sparkContext.broadcast(both), mixer.tokens
    cells, kinds = GATES * PREDICTORS, CLUSTERS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Mixer(*tables.value.T), 0
        own.tokens = tokens
        for batch in gathered(batches):
            words, kind, n = byte_list(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for part in spell_blocks(words):
                seen += own.learn(words[part], kind[part], n[part])
        if seen:
            # whole numbers: sums don't depend on their order
            share = min(seen, 1 << 24)
            values = np.concatenate((np.round(own.weights.astype(float) * 2.0**16).astype(np.int64).reshape(-1) * share, own.refine.astype(np.int64).reshape(-1), np.round((own.trust - 1) * 16).astype(np.int64).reshape(-1), [share]))
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(values[at])], ["cell", "v"])

    # in order, so that what is learned doesn't depend on the order of arrival; mini-batches mix words by hash
    ordered = counts.sortWithinPartitions("word", "class")
    sums = np.zeros(cells + 2 * 256 * LEVELS + 2 * kinds + 1)
    for r in ordered.mapInArrow(run, "cell int, v long").groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        sums[r.cell] = float(r.v)
    if sums[-1]:
        mixer.weights = (sums[:cells] / sums[-1] / 2.0**16).astype(np.float32).reshape(GATES, PREDICTORS)
    mixer.refine = sums[cells : -1 - 2 * kinds].reshape(2, -1)
    mixer.trust += sums[-1 - 2 * kinds : -1].reshape(2, -1) / 16
    mixer.prepare()
    tables.destroy()
    return mixer


def word_costs(counts: DataFrame, mixer: Mixer) -> DataFrame:
    """(word, class, c, first, cost): training count of the word, log10 probability of the word in its class.

    first: true in one row of each word.
    """
    shared = counts.sparkSession.sparkContext.broadcast(mixer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            words, kind, n = byte_list(batch.column(0)), batch.column(1).to_numpy(), batch.column(4).to_numpy()
            cost = [shared.value.word_log10(words[part], kind[part], n[part]) for part in spell_blocks(words)]
            yield from batch.drop_columns("n").append_column("cost", pa.array(np.concatenate(cost) if cost else np.zeros(0))).to_batches()

    c = counts.groupBy("word").agg(F.sum("n").alias("c"), F.min("class").alias("_first"))
    rows = counts.select("word", "class", "n").join(c, "word").select("word", "class", "c", (F.col("class") == F.col("_first")).alias("first"), "n")
    return rows.mapInArrow(run, "word binary, class int, c long, first boolean, cost double")


def lm_scores(docs: DataFrame, hot_words: int = HOT) -> DataFrame:
    """Scores of all documents; see the module's description."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out().alias("held_out"))
    votes = clusters(co_occurrence(docs.where("NOT held_out")))
    # sorted, so that neighbours share their beginnings
    counts = materialize(word_counts(docs, votes).sortWithinPartitions("word", "class"), "lm-counts")
    costs = materialize(word_costs(counts, train(counts)), "lm-costs")
    total = costs.agg(F.coalesce(F.sum(F.when(F.col("first"), F.col("c"))), F.lit(0)).alias("n"), F.count_if((F.col("c") > 0) & F.col("first")).alias("v")).first()
    floor = total.n + 0.5 * (total.v + 1)
    # the hot words, at most ``hot_words``
    best = costs.where("c > 0 AND first").orderBy(F.desc("c"), "word").limit(hot_words).select("word")
    known, hot_cost, hot_count = Vocabulary(), np.full((hot_words, CLUSTERS + 1), np.nan, np.float32), np.zeros(hot_words + 1, np.int64)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.serialize().to_pybytes()], pa.binary())], ["rows"])

    kept = costs.join(best, "word", "left_semi").select("word", "class", "c", "cost").mapInArrow(packed, "rows binary")
    fields = pa.schema([("word", pa.binary()), ("class", pa.int32()), ("c", pa.int64()), ("cost", pa.float64())])
    for r in kept.toLocalIterator():
        rows = pa.ipc.read_record_batch(pa.py_buffer(r.rows), fields)
        coded = rows.column(0).dictionary_encode()
        i = known.numbers(byte_list(coded.dictionary))[coded.indices.to_numpy()]
        hot_count[i], hot_cost[i, rows.column(1).to_numpy()] = rows.column(2).to_numpy(), rows.column(3).to_numpy()
    hot = dict(known)
    shared = spark.sparkContext.broadcast((hot, hot_cost, hot_count, votes))
    schema = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, word binary, class int, n long"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_cost, hot_count, votes = shared.value
        row = TaskContext.get().partitionId() << 40
        known, facts = Vocabulary(), [np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64)]
        for batch in blocks(batches, limit=TEXT_BLOCK):
            numbers, starts = tokenized(batch.column(1), known)
            fresh = known.words[len(facts[0]) :]
            place = np.fromiter(map(hot.get, fresh, repeat(-1)), np.int32, len(fresh))
            size = np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1
            facts = [np.concatenate(x) for x in zip(facts, (place, np.log10((hot_count[place] + 0.5) / floor), size))]
            facts[2][known[END]] = 1
            place, base, size = (x[numbers] for x in facts)
            kind = causal_classes(known.buckets[numbers], starts, votes)
            warm = place >= 0
            score = np.where(warm, hot_cost[place, kind], 0).astype(float)
            n = np.diff(np.append(starts, len(numbers)))
            keys = row + np.arange(len(starts))
            row += len(starts)
            sums = [np.add.reduceat(x, starts) for x in (warm.astype(np.int64), np.where(warm, base, 0), score, size)]
            cells = [pa.array(keys), batch.column(0), batch.column(2), pa.array(n), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays([*cells, *(pa.nulls(len(n), t) for t in kinds[8:])], names)
            # words that aren't hot: one row for each word and class of a document
            at = np.flatnonzero(~warm)
            text = np.repeat(np.arange(len(starts)), n)[at]
            wide = len(known) * (CLUSTERS + 1)
            pairs, times = np.unique(text * wide + numbers[at] * (CLUSTERS + 1) + kind[at], return_counts=True)
            text, word = np.divmod(pairs, wide)
            word, kind = np.divmod(word, CLUSTERS + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[text]), *(pa.nulls(len(pairs), t) for t in kinds[1:8]), pa.array([known.words[i] for i in word.tolist()], pa.binary()), pa.array(kind.astype(np.int32)), pa.array(times)], names
            )
            if len(known) > WORDS_KEPT:
                known, facts = Vocabulary(), [x[:0] for x in facts]

    rows = materialize(docs.select("doc_id", "text", "held_out").mapInArrow(run, schema), "lm-rows")
    cold = rows.where("word IS NOT NULL").select("key", "word", "class", "n").join(costs, ["word", "class"])
    more = cold.groupBy("key").agg(F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(floor))).alias("base"), F.sum(F.col("n") * F.col("cost")).alias("cost"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"))
    texts = rows.where("word IS NULL").drop("word", "class", "n").join(more, "key", "left")
    score = F.col("score") + F.coalesce("cost", F.lit(0.0))
    return texts.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total.n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), score.alias("score"), (score * F.lit(-np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte")
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
