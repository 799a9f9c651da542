"""Packing documents into sequences by minimum bin slack.

A document's tokens are those of a byte-level BPE vocabulary (a ``tokenizers`` file) followed by an end
token. Documents longer than a sequence are cut into pieces of the full length, of which the first may be
shorter; no other is cut.

Sequences are filled one after the other (Gupta and Ho, 1999): the longest piece left is placed, then a
subset-sum dynamic program over bitsets, one bit for each fill level, finds the fullest combination of
lengths available, which is removed. Only lengths matter to it, so it runs on a histogram of at most
``capacity`` counters, and a combination that fits many times is taken many times at once (at most an eighth of
what the counts allow, so that no length runs out early). Pieces then look up their place by their
rank among the pieces of the same length: a rank is the number of such pieces in earlier hash buckets of
doc_id plus the rank inside the bucket, so no length gathers in one task.

Null or empty text: the end token alone. Null doc_ids are packed like others. Rows that repeat a doc_id
are packed once each. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm._common import blocks, documents, materialize

CAPACITY = 1024
END = 2
PIECES_PER_BUCKET = 100_000
PATTERN = "|".join([r"'s|'t|'re|'ve|'m|'ll|'d", r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+", r"\s+(?!\S)", r"\s+"])

_loaded: dict = {}


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def load_encoder(path: str):
    """A tiktoken encoder with the ids of a byte-level BPE ``tokenizers`` file; kept for the process."""
    if path in _loaded:
        return _loaded[path]
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, byte = spec["model"], byte_symbols()
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if model["type"] != "BPE" or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"] or merged != sorted(merged):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary in merge order")
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    _loaded[path] = encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return encoder


def encode(path: str, text: str) -> np.ndarray:
    """Ids of a text as the ``tokenizers`` library gives them without its own special tokens."""
    try:
        ids = load_encoder(path).encode_to_numpy(text, allowed_special="all")
    except (ValueError, RuntimeError):
        # the pattern's look-ahead gives up on very long white space; the library itself doesn't
        from tokenizers import Tokenizer

        key = f"{path} as is"
        if key not in _loaded:
            _loaded[key] = Tokenizer.from_file(path)
            _loaded[key].no_truncation(), _loaded[key].no_padding()
        ids = np.array(_loaded[key].encode(text, add_special_tokens=False).ids)
    return ids.astype("<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    first = n - capacity * ((n - 1) // capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(path, text or ""), np.array([end], "<u4"))
                rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            doc, k, s, n, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: list[int], capacity: int) -> list[int]:
    """Lengths of the fullest combination of what is left, with the longest piece; ``counts`` by length."""
    longest = max(n for n in range(1, len(counts)) if counts[n])
    room = capacity - longest
    steps: list[tuple[int, int]] = []
    reach, mask = 1, (1 << (room + 1)) - 1
    for n in range(min(longest, room), 0, -1):
        left = counts[n] - (n == longest)
        for _ in range(min(left, room // n)):
            grown = (reach | reach << n) & mask
            if grown == reach:
                break
            steps.append((n, reach))
            reach = grown
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    level, chosen = reach.bit_length() - 1, [longest]
    for n, before in reversed(steps):
        if not before >> level & 1:
            chosen.append(n)
            level -= n
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places by length: (length, first rank, end rank, times a sequence, first sequence, offset); sequences."""
    counts = [0] * (capacity + 1)
    for n, k in histogram.items():
        counts[n] = k
    taken, places, sequences = [0] * (capacity + 1), [], 0
    while any(counts):
        chosen = fullest(counts, capacity)
        times: dict[int, int] = {}
        for n in chosen:
            times[n] = times.get(n, 0) + 1
        fits = min(counts[n] // k for n, k in times.items())
        repeat = fits if times == {capacity: 1} else max(1, fits // 8)
        at = 0
        for n, k in times.items():
            places.append((n, taken[n], taken[n] + k * repeat, k, sequences, at))
            taken[n] += k * repeat
            counts[n] -= k * repeat
            at += k * n
        sequences += repeat
    return places, sequences


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with their rank (from 0) among the rows of the same length."""
    buckets = max(1, total // PIECES_PER_BUCKET)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    return rows.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("inside") + F.col("before")).drop("inside", "before", "bucket")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all pieces."""
    rows = materialize(pieces(docs, path, capacity, end), "pack-pieces")
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``capacity`` rows at most
    places, _ = plan(histogram, capacity)
    places.sort()
    table = np.array(places, np.int64).reshape(-1, 6)
    lengths = table[:, 0]
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one sorted key for (length, first rank)
        wide = int(table[:, 2].max(initial=0)) + 1
        keys = lengths * wide + table[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            hit = table[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            turn, slot = np.divmod(rank - hit[:, 1], hit[:, 3])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(hit[:, 4] + turn), pa.array(hit[:, 5] + slot * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(rows, sum(histogram.values())).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(place, fields)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
