"""Incremental, reversible line deduplication.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. A key of
at least ``min_chars`` code points that occurs in several documents is kept only in the smallest
doc_id that holds it; there all its lines stay.

The index has two parts, both sharded by key hash and both in the shared folder:

* an exact reference table (key, doc_id, lines): one row for each document that holds a key, from which a key's
  count and owner follow. A document can be deleted again, and its lines return to the next owner;
* one cuckoo filter for each shard, made of the distinct keys. An insertion asks it which keys of the
  new batch may be known; the others are new for certain and need not meet the reference table.

The table is kept in segments: an insertion writes only what is new and a deletion only the ids that go; after
``SEGMENTS`` changes they are written together.

A result comes through filters too: keys counted in several documents are put into one filter a shard. A scan of
the texts asks them; a document without a hit is done where it is. For the others, references with a hit meet the
exact owners (those of keys in more than ``HOT_REFS`` documents are broadcast, the rest shuffled), and their texts
move once to meet the keys they lose. Where the filters are larger than ``MOST_FILTERS`` bytes, every document counts
as one with hits.

A null or empty text is one empty line. Rows
with a null doc_id sort before all others and own keys like any other document; they can be deleted too; rows that
repeat a doc_id count as one document. Extra columns stay, except that one
with the name of a result column is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm._common import as_bytes, blocks, materialize, plus, without

MIN_CHARS = 10
KEYS_PER_SHARD = 200_000
#: Bytes of filters that are broadcast at most.
MOST_FILTERS = 64 << 20
#: Owners of keys that more references than this share are broadcast: at most one for so many references.
HOT_REFS = 50_000
SEGMENTS = 16


class CuckooFilter:
    """Partial-key cuckoo filter: 16-bit fingerprints, buckets of four, with deletion.

    A key inserted is always found. A key not inserted is found with probability of about 1e-4.
    """

    SLOTS = 4

    def __init__(self, capacity: int, table: bytes | None = None):
        self.n = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.8)))))
        self.table = np.zeros((self.n, self.SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(-1, self.SLOTS).copy()
        self.n = len(self.table)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        mark = ((keys >> np.uint64(48)).astype(np.uint16) % np.uint16(65535)) + np.uint16(1)
        first = (keys & np.uint64(self.n - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, place, mark):
        jump = (mark.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(3)
        return (place ^ (jump & np.uint64(self.n - 1)).astype(np.int64)) & (self.n - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> None:
        """Insert distinct keys; the table doubles nothing: capacity was set before, kicks settle the rest."""
        mark, a, b = self._places(keys)
        left = np.arange(len(keys))
        for place in (a, b):
            for slot in range(self.SLOTS):
                if not len(left):
                    return
                free = left[self.table[place[left], slot] == 0]
                _, once = np.unique(place[free], return_index=True)
                put = free[once]
                self.table[place[put], slot] = mark[put]
                left = np.setdiff1d(left, put, assume_unique=True)
        for i in left.tolist():
            self._kick(mark[i : i + 1], a[i : i + 1])

    def _kick(self, mark: np.ndarray, place: np.ndarray) -> None:
        for step in range(5000):
            p = int(place[0])
            free = np.flatnonzero(self.table[p] == 0)
            if len(free):
                self.table[p, free[0]] = mark[0]
                return
            slot = (step * 7 + p) % self.SLOTS
            out = self.table[p, slot : slot + 1].copy()
            self.table[p, slot] = mark[0]
            mark, place = out, self._other(place, out)
        raise OverflowError("the cuckoo filter is full")

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted; removing others would harm."""
        mark, a, b = self._places(keys)
        for m, x, y in zip(mark.tolist(), a.tolist(), b.tolist()):
            for p in (x, y):
                at = np.flatnonzero(self.table[p] == m)
                if len(at):
                    self.table[p, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()


def _split(text: bytes) -> list[bytes]:
    return text.split(b"\n")


_SPACE = b" \t\n\x0b\x0c\r"


def _keys(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """128-bit key hash for each line, None where the key is too short."""
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip(_SPACE).lower()
        # continuation bytes don't count as code points
        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


REFS = "hi long, lo long, doc_id long, lines long"


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row (hi, lo, doc_id, lines) for each key of each document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            ids, keys, counts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                found: dict[bytes, int] = {}
                for key in _keys(_split(text), min_chars):
                    if key is not None:
                        found[key] = found.get(key, 0) + 1
                ids += [doc] * len(found)
                keys += found
                counts += found.values()
            words = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["hi", "lo", "doc_id", "lines"])

    return docs.select("doc_id", "text").mapInArrow(run, REFS)


@dataclass
class LineIndex:
    """State of the operator: the exact reference table and the filter of each shard."""

    refs: DataFrame
    filters: DataFrame | None
    shards: int
    min_chars: int = MIN_CHARS
    changes: int = 0

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
        refs = materialize(references(docs, min_chars), "line-refs")
        shards = max(1, -(-refs.count() // keys_per_shard))
        return cls(refs, materialize(_filters(refs, shards), "line-filters"), shards, min_chars)

    def _next(self, refs: DataFrame, filters: DataFrame) -> LineIndex:
        changes = self.changes + 1
        if changes % SEGMENTS == 0:
            refs = materialize(refs, "line-refs")
        return LineIndex(refs, filters, self.shards, self.min_chars, changes)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents whose ids are new. Keys that the filters don't know skip the reference table."""
        new = materialize(references(docs, self.min_chars), "line-refs")
        known = materialize(self.maybe_known(new), "line-known")
        fresh = new.join(known, ["hi", "lo"], "left_anti")
        # only the keys reported need the exact table
        surely = known.join(self.refs.join(known, ["hi", "lo"], "left_semi").select("hi", "lo").distinct(), ["hi", "lo"], "left_anti")
        refs = self.refs.unionByName(new)
        filters = materialize(_grown(self.filters, fresh.select("hi", "lo").unionByName(surely), self.shards, refs), "line-filters")
        return self._next(refs, filters)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Take documents out again; keys that no document holds any more leave the filters."""
        ids = materialize(ids.select(F.col("doc_id").alias("_gone")).distinct(), "line-gone")
        same = F.col("doc_id").eqNullSafe(F.col("_gone"))
        refs = self.refs.join(ids, same, "left_anti")
        touched = materialize(self.refs.join(ids, same, "left_semi").select("hi", "lo").distinct(), "line-touched")
        gone = touched.join(refs.join(touched, ["hi", "lo"], "left_semi").select("hi", "lo").distinct(), ["hi", "lo"], "left_anti")
        return self._next(refs, materialize(_shrunk(self.filters, gone, self.shards), "line-filters"))

    def maybe_known(self, refs: DataFrame) -> DataFrame:
        """Distinct keys of ``refs`` that the filters report; false reports are possible, misses aren't."""
        keys = refs.select("hi", "lo").distinct().withColumn("shard", _shard(self.shards))

        def probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
            if not filters.num_rows:
                return keys.slice(0, 0).select(["hi", "lo"])
            hit = CuckooFilter(0, filters["bits"][0].as_py()).contains(keys["lo"].to_numpy())
            return keys.filter(pa.array(hit)).select(["hi", "lo"])

        return keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(probe, "hi long, lo long")

    def owners(self) -> DataFrame:
        """Keys that several documents hold: (hi, lo, owner, n references). The count combines before the shuffle."""
        held = self.refs.groupBy("hi", "lo").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unnamed"), F.count("*").alias("n"))
        # a null id sorts before all others: it owns what it holds
        return held.where((F.col("owner") != F.col("last")) | (F.col("unnamed") & F.col("last").isNotNull())).select("hi", "lo", F.when(~F.col("unnamed"), F.col("owner")).alias("owner"), "n")

    def drops(self, owners: DataFrame, repeats: Repeats | None) -> DataFrame:
        """For each document that loses lines, the keys it loses (hi and lo in turn)."""
        refs = self.refs.select("hi", "lo", "doc_id").where("doc_id IS NOT NULL")
        if repeats:
            refs = repeats.filtered(refs)
        hot = owners.where(F.col("n") > HOT_REFS).select("hi", "lo", F.col("owner").alias("hot_owner"), F.lit(True).alias("hot"))
        met = refs.join(F.broadcast(hot), ["hi", "lo"], "left")
        cold = met.where("hot IS NULL").select("hi", "lo", "doc_id").join(owners.where(F.col("n") <= HOT_REFS), ["hi", "lo"]).select("hi", "lo", "doc_id", "owner")
        lost = met.where("hot").select("hi", "lo", "doc_id", F.col("hot_owner").alias("owner")).unionByName(cold)
        lost = lost.where(F.col("owner").isNull() | (F.col("doc_id") != F.col("owner")))
        return lost.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("hi", "lo"))).alias("_lost"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with columns n_lines, n_dropped and kept_text added."""
        out = "n_lines long, n_dropped long, kept_text string"
        docs = without(docs, out)
        other = [c for c in docs.columns if c not in ("doc_id", "text")]
        docs = docs.select("doc_id", "text", *(F.col(f"`{c}`") for c in other))
        owners = materialize(self.owners(), "line-owners")
        repeats = Repeats.load(materialize(_filters(owners, self.shards), "line-repeats"), self.shards)
        drops, min_chars = self.drops(owners, repeats), self.min_chars
        done = None
        if repeats:
            marked = repeats.marked(docs, min_chars)
            hit = F.col("_hit") & F.col("doc_id").isNotNull()
            done = marked.where(~hit).drop("_hit").withColumns({"n_dropped": F.lit(0).cast("long"), "kept_text": F.coalesce("text", F.lit(""))})
            docs = marked.where(hit).drop("_hit", "n_lines")
        joined = docs.join(drops, "doc_id", "left").select("doc_id", "text", *(F.col(f"`{c}`") for c in other), "_lost")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                lines, dropped, kept = [], [], []
                for text, keys in zip(as_bytes(batch.column(1)), batch.column(batch.num_columns - 1)):
                    parts = _split(text)
                    lines.append(len(parts))
                    if not keys.is_valid:
                        dropped.append(0)
                        kept.append(text)
                        continue
                    raw = np.array(keys.values.to_numpy(), np.int64).tobytes()
                    lost = {raw[i : i + 16] for i in range(0, len(raw), 16)}
                    stay = [p for p, k in zip(parts, _keys(parts, min_chars)) if k not in lost]
                    dropped.append(len(parts) - len(stay))
                    kept.append(b"\n".join(stay))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*batch.schema.names[:-1], "n_lines", "n_dropped", "kept_text"])

        changed = joined.mapInArrow(run, plus(docs.select("doc_id", "text", *(F.col(f"`{c}`") for c in other)), out))
        return changed if done is None else done.unionByName(changed)


@dataclass
class Repeats:
    """Filters, by shard, of the keys that several documents hold; at most MOST_FILTERS bytes, so they are broadcast."""

    tables: dict[int, bytes]
    shards: int

    @classmethod
    def load(cls, filters: DataFrame, shards: int) -> Repeats | None:
        """None where the filters are too large to be sent."""
        if filters.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0] > MOST_FILTERS:
            return None
        return cls({r.shard: bytes(r.bits) for r in filters.collect()}, shards)

    def opened(self) -> dict[int, CuckooFilter]:
        return {k: CuckooFilter(0, v) for k, v in self.tables.items()}

    def contains(self, filters: dict[int, CuckooFilter], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(hi), bool)
        shard = hi % self.shards
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for k, f in filters.items():
            at = order[ends[k] : ends[k + 1]]
            if len(at):
                hit[at] = f.contains(lo[at])
        return hit

    def filtered(self, refs: DataFrame) -> DataFrame:
        """The references (hi, lo, ...) whose key may be in a filter."""
        shared = refs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = shared.value.opened()
            for batch in batches:
                hit = shared.value.contains(filters, batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield batch.filter(pa.array(hit))

        return refs.mapInArrow(run, refs.schema)

    def marked(self, docs: DataFrame, min_chars: int) -> DataFrame:
        """``docs`` (doc_id, text, ...) plus n_lines and _hit: whether a line's key may be in a filter."""
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = shared.value.opened()
            for batch in blocks(batches):
                keys, owner, lines = [], [], []
                for i, text in enumerate(as_bytes(batch.column(1))):
                    parts = _split(text)
                    own = [k for k in _keys(parts, min_chars) if k is not None]
                    lines.append(len(parts))
                    keys += own
                    owner += [i] * len(own)
                words = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                hit = shared.value.contains(filters, words[:, 0], words[:, 1])
                any_hit = np.zeros(batch.num_rows, bool)
                any_hit[np.array(owner, np.int64)[hit]] = True
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.int64()), pa.array(any_hit)], [*batch.schema.names, "n_lines", "_hit"])

        return docs.mapInArrow(run, plus(docs, "n_lines long, _hit boolean"))


def _shard(shards: int):
    return F.pmod(F.col("hi"), F.lit(shards)).cast("int")


def _filters(refs: DataFrame, shards: int) -> DataFrame:
    """A filter for each shard. A shard holds about KEYS_PER_SHARD keys however large the corpus is."""
    keys = refs.select("hi", "lo").distinct().withColumn("shard", _shard(shards))

    def make(keys: pa.Table) -> pa.Table:
        made = CuckooFilter(2 * keys.num_rows)
        made.insert(keys["lo"].to_numpy())
        return pa.table({"shard": keys["shard"].slice(0, 1), "bits": pa.array([made.to_bytes()], pa.binary())})

    return keys.groupBy("shard").applyInArrow(make, "shard int, bits binary")


def _grown(filters: DataFrame, fresh: DataFrame, shards: int, refs: DataFrame) -> DataFrame:
    keys = fresh.select("hi", "lo").distinct().withColumn("shard", _shard(shards))

    def add(filters: pa.Table, keys: pa.Table) -> pa.Table:
        shard = (filters if filters.num_rows else keys)["shard"].slice(0, 1)
        made = CuckooFilter(0, filters["bits"][0].as_py()) if filters.num_rows else CuckooFilter(2 * keys.num_rows)
        full = False
        try:
            made.insert(keys["lo"].to_numpy())
        except OverflowError:
            full = True
        return pa.table({"shard": shard, "bits": pa.array([None if full else made.to_bytes()], pa.binary())})

    grown = materialize(filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(add, "shard int, bits binary"), "line-filters")
    # a filter that became too full is built anew from the exact table
    full = grown.where("bits is null").select("shard")
    again = _filters(refs.withColumn("shard", _shard(shards)).join(full, "shard", "left_semi").drop("shard"), shards)
    return grown.where("bits is not null").unionByName(again)


def _shrunk(filters: DataFrame, gone: DataFrame, shards: int) -> DataFrame:
    keys = gone.select("hi", "lo").distinct().withColumn("shard", _shard(shards))

    def cut(filters: pa.Table, keys: pa.Table) -> pa.Table:
        made = CuckooFilter(0, filters["bits"][0].as_py())
        made.delete(keys["lo"].to_numpy())
        return pa.table({"shard": filters["shard"], "bits": pa.array([made.to_bytes()], pa.binary())})

    return filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(cut, "shard int, bits binary")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Deduplicate the lines of all documents: ``docs`` plus n_lines, n_dropped and kept_text."""
    return LineIndex.build(docs, min_chars).apply(docs)


def op5(spark: SparkSession, docs: DataFrame) -> DataFrame:
    done = line_dedup(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, line, i,
         translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= {MIN_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT keyed.doc_id, i, line, (owner IS NOT NULL AND keyed.doc_id <> owner) AS gone
  FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
