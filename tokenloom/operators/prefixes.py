"""Totals over all substrings of the pretokens without a row for each of them.

Every substring is a prefix of a suffix. Suffixes are partitioned by their first characters and sorted, so a prefix
is a run of neighbours; runs of every length are summed by array operations, batch by batch, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are laid out at once.
_CELLS = 4_000_000


def _suffixes(counts: DataFrame, least: int, most: int | None, *more: Column) -> DataFrame:
    """Sorted suffixes (suffix, frequency, ...) of at least ``least`` characters, cut at ``most``; ``start`` may be used in ``more``."""
    n = F.length("pretoken")
    rows = counts.where(n >= least).select(*counts.columns, F.explode(F.sequence(F.lit(0), n - least)).alias("start"))
    suffix = F.substring(F.col("pretoken"), F.col("start") + 1, F.length("pretoken") if most is None else F.lit(most))
    return rows.select(suffix.alias("suffix"), "frequency", *more).repartition(F.substring("suffix", 1, least)).sortWithinPartitions("suffix")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches, their suffixes as rows of code points with zeros behind, and the suffixes' lengths."""
    for batch in batches:
        size = pc.utf8_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(size):
            n = len(size) - at
            while n > 1 and n * (int(size[at : at + n].max()) + 1) > _CELLS:
                n //= 2
            part, length = batch.slice(at, n), size[at : at + n]
            flat = np.frombuffer("".join(part.column(0).to_pylist()).encode("utf-32-le"), np.uint32)
            codes = np.zeros((n, int(length.max()) + 1), np.uint32)
            codes[np.arange(codes.shape[1]) < length[:, None]] = flat
            yield part, codes, length
            at += n


def _after(last: np.ndarray, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with the last one of before in front; of each, how many characters it shares with the one before it (the first: -1)."""
    width = max(codes.shape[1], len(last) + 1)
    every = np.zeros((len(codes) + 1, width), np.uint32)
    every[0, : len(last)] = last
    every[1:, : codes.shape[1]] = codes
    length = np.concatenate(([len(last)], length))
    differ = every[1:] != every[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), width)
    return every, length, np.concatenate(([-1], np.minimum(shared, np.minimum(length[1:], length[:-1]))))


def _strings(parts: list[np.ndarray]) -> pa.Array:
    """Rows of code points as strings."""
    flat = np.concatenate([p.ravel() for p in parts])
    sizes = np.concatenate([(1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)).sum(1) for p in parts])
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(flat.tobytes().decode("utf-32-le").encode()))


def substring_totals(counts: DataFrame, more_than: int = 1, least: int = 2, most: int | None = None, places: bool = False, costs: Column | None = None) -> DataFrame:
    """(token, count) of the substrings whose count, weighted by frequency, is above ``more_than``.

    ``places``: also edges (occurrences in distinct pretokens), first_start and last_end. ``costs``: array over the
    n + 1 cuts of a pretoken; also edges, penalised (occurrences whose two cuts cost something) and total (their cost).
    """
    more = [F.col("start")] * places
    if costs is not None:
        counts = counts.select("pretoken", "frequency", costs.cast("array<double>").alias("_costs"))
        n = F.size("_costs") - F.col("start")
        more.append(F.slice("_costs", F.col("start") + 1, n if most is None else F.least(n, F.lit(most + 1))).alias("costs"))
    else:
        counts = counts.select("pretoken", "frequency")
    names = ["token", "count", *(["edges"] if more else []), *(["first_start", "last_end"] if places else []), *(["penalised", "total"] if costs is not None else [])]
    # how a total over neighbours is made, and how it goes on with the next batch
    ways = [np.add, *([np.add] if more else []), *([np.minimum, np.maximum] if places else []), *([np.add, np.add] if costs is not None else [])]
    none = {np.add: 0, np.minimum: np.iinfo(np.int64).max, np.maximum: -1}

    priced, counted = costs is not None, bool(more)  # columns can't go to the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(0, np.uint32)
        open_: list[dict[int, float]] = [{} for _ in ways]

        def made(tokens: list[np.ndarray], found: list[list[np.ndarray]]) -> pa.RecordBatch:
            columns = [np.concatenate(f) if f else np.zeros(0) for f in found]
            kinds = [pa.float64() if n == "total" else pa.int64() for n in names[1:]]
            return pa.RecordBatch.from_arrays([_strings(tokens), *(pa.array(c.astype(np.float64 if k == pa.float64() else np.int64)) for c, k in zip(columns, kinds))], names)

        def spelled(final: np.ndarray) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
            keep = [k for k, v in open_[0].items() if v > more_than]
            return [final[None, :k] for k in keep], [[np.array([o[k]]) for k in keep] for o in open_]

        for batch, codes, length in _slices(batches):
            every, length, shared = _after(last, codes, length)
            values = [np.concatenate(([0], batch.column(1).to_numpy(zero_copy_only=False)))]
            if counted:
                values.append(np.concatenate(([0], np.ones(len(codes), np.int64))))
            if places:
                start = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                values += [np.concatenate(([none[np.minimum]], start)), np.concatenate(([-1], start))]
            if priced:
                each = batch.column(batch.num_columns - 1)
                flat, own = each.flatten().to_numpy(zero_copy_only=False), length[1:] + 1
                first = np.cumsum(own) - own
            tokens, found, now = [], [[] for _ in ways], [{} for _ in ways]
            for k in range(least, int(length.max()) + 1):
                cut = np.flatnonzero(shared < k)
                there = length[cut] >= k
                if not there.any():
                    continue
                level = list(values)
                if priced:
                    long = length[1:] >= k
                    paid = np.zeros(len(length))
                    paid[1:][long] = flat[first[long]] + flat[first[long] + k]
                    level += [(paid > 0).astype(np.int64), paid]
                sums = [w.reduceat(v, cut)[there] for w, v in zip(ways, level)]
                at = cut[there]
                if places:
                    sums[3] = np.where(sums[3] < 0, -1, sums[3] + k)
                if at[0] == 0:
                    for w, s, o in zip(ways, sums, open_):
                        s[0] = w(s[0], o.get(k, none[w]))
                if there[-1]:  # the run of the last row goes on
                    for s, o in zip(sums, now):
                        o[k] = s[-1].item()
                    at, sums = at[:-1], [s[:-1] for s in sums]
                keep = sums[0] > more_than
                if keep.any():
                    tokens.append(every[at[keep], :k])
                    for f, s in zip(found, sums):
                        f.append(s[keep])
            last, open_ = every[-1, : length[-1]].copy(), now
            if tokens:
                yield made(tokens, found)
        tokens, found = spelled(last)
        if tokens:
            yield made(tokens, found)

    rows = _suffixes(counts, least, most, *more)
    return rows.mapInArrow(run, ", ".join(f"{n} {'string' if n == 'token' else 'double' if n == 'total' else 'long'}" for n in names))


def edge_counts(counts: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """(pretoken, edges): how many of its substrings occur more than once, in it or elsewhere; 0 for pretokens without any.

    All substrings of a pretoken of frequency 2 do. Of the others' suffixes those prefixes do that a neighbour shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before, whose = np.zeros(0, np.uint32), 0, pa.array([None], pa.string())
        schema = pa.schema([("pretoken", pa.string()), ("kept", pa.int64())])

        def made(names: pa.Array, kept: np.ndarray) -> pa.RecordBatch:
            full = np.maximum(kept - least + 1, 0)
            there = pa.array(full > 0)
            return pa.RecordBatch.from_arrays([names.filter(there), pa.array(full).filter(there)], schema=schema)

        for batch, codes, length in _slices(batches):
            _, length, shared = _after(last, codes, length)
            shared[0] = before
            names = pa.concat_arrays([whose, batch.column(2).cast(pa.string())])
            kept = np.maximum(shared[:-1], shared[1:])
            once = pc.is_valid(names[:-1])
            yield made(names[:-1].filter(once), kept[once.to_numpy(zero_copy_only=False)])
            last, before, whose = codes[-1, : length[-1]].copy(), int(shared[-1]), names[-1:]
        if whose[0].is_valid:
            yield made(whose, np.array([before]))

    n = F.length("pretoken").cast("long")
    top = n if most is None else F.least(n, F.lit(most))
    every = F.when(top >= least, (top - least + 1) * (n + 1) - (top * (top + 1) - F.lit(least * (least - 1))) / 2).otherwise(0).cast("long")
    rows = counts.select("pretoken", "frequency")
    kept = _suffixes(rows, least, most, F.when(F.col("frequency") == 1, F.col("pretoken")).alias("pretoken")).mapInArrow(run, "pretoken string, kept long")
    once = rows.where("frequency = 1").select("pretoken", F.lit(0).cast("long").alias("kept")).unionByName(kept).groupBy("pretoken").agg(F.sum("kept").alias("edges"))
    return rows.where("frequency > 1").select("pretoken", every.alias("edges")).unionByName(once)
