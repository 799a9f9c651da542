"""SimHash fingerprints and search within a Hamming radius.

Terms are the words of a text (A-Z lower-cased, runs without ASCII white space) and its pairs of
neighbouring words, each weighted by 1 + floor(log2(occurrences)), at most 16. Every term's 128-bit hash
votes for or against each bit; the fingerprint has a 1 where the votes for it prevail (a tie gives 0).
It is given as 32 hex digits. A text without words has the fingerprint 0. The likeness of two
fingerprints is the share of equal bits.

``search`` finds all fingerprints within a radius by permuted block tables: blocks of bits that two
fingerprints within the radius must share come in front, and only entries that agree on them are compared.

Null text is an empty text. Rows with a null doc_id come before all others in the order of documents;
rows that repeat a doc_id follow each other in the order of their texts. An empty table gives no rows;
a single document is its own successor. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm._common import WordHashes, materialize, mix

BITS = 128
RADIUS = 3
#: For a byte, eight lanes of eight bits, each 0 or 1: votes are added without unpacking the bits.
_VOTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint8).view(np.uint64).reshape(256)
#: So many terms of weight 16 at most fit into a lane.
_RUN = 15


def fingerprint(words: np.ndarray) -> bytes:
    """16 bytes; ``words`` holds the word hashes of the text in order."""
    if not len(words):
        return bytes(BITS // 8)
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    terms = np.concatenate((words, pairs))
    terms.sort()
    edge = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
    counts = np.diff(np.append(edge, len(terms)))
    terms = terms[edge]
    weights = np.minimum(np.frexp(counts.astype(np.float64))[1], 16).astype(np.uint64)
    both = np.stack((mix(terms), mix(terms ^ np.uint64(0xA0761D6478BD642F))), axis=1)
    votes = _VOTES[both.view(np.uint8).reshape(len(terms), BITS // 8)]
    if int(weights.max()) > 1:
        votes *= weights[:, None]
    lanes = np.add.reduceat(votes, np.arange(0, len(terms), _RUN), axis=0)
    total = lanes.view(np.uint8).reshape(-1, BITS).sum(0, dtype=np.int64)
    return np.packbits(2 * total > int(weights.sum())).tobytes()


def _words(text: str, hashes: WordHashes) -> np.ndarray:
    return hashes.of(text.encode().lower().split())


def likeness(x: bytes, y: bytes) -> float:
    return 1 - (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` gives way to as much of the start of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc, text: str, mark: bytes, following: str, next_mark: bytes, hashes: WordHashes) -> tuple:
    changed = edited(text, following)
    changed_mark = mark if changed == text else fingerprint(_words(changed, hashes))
    return doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark.hex(), changed_mark.hex(), likeness(mark, changed_mark), likeness(mark, next_mark)


def _batch(rows: list[tuple], width: int) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return [pa.array([r[i] for r in rows], kinds[i]) for i in range(width)]


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and the likeness to the next document.

    One range shuffle puts the documents in order; each task then holds one document and its successor.
    Only the first and the last document of each task meet those of other tasks.
    """
    part = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = part.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        task = TaskContext.get().partitionId()
        before: tuple | None = None

        def out(rows: list[tuple], kind: str, texts: list | None = None) -> pa.RecordBatch:
            n = len(rows)
            cells = _batch(rows, 7) if kind == "done" else [pa.array([r[0] for r in rows], pa.int64()), *(pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]
            return pa.RecordBatch.from_arrays([*cells, pa.array([kind] * n), pa.array([task] * n, pa.int32()), pa.array(texts or [None] * n, pa.string())], [*names, "kind", "task", "text"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                piece = batch.slice(at, 256)
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    mark = fingerprint(_words(text, hashes))
                    if before is None:
                        yield out([(doc,)], "head", [text])
                    else:
                        rows.append(_row(*before, text, mark, hashes))
                    before = (doc, text, mark)
                if rows:
                    yield out(rows, "done")
        if before is not None:
            yield out([(before[0],)], "last", [before[1]])

    made = materialize(ordered.mapInArrow(run, RESULT + ", kind string, task int, text string"), "simhash")
    ends = made.where("kind <> 'done'")
    # one row a task: its number and the number of the next task that has rows
    tasks = ends.where("kind = 'head'").select("task")
    order = Window.partitionBy(F.lit(0)).orderBy("task")
    following = tasks.select("task", F.coalesce(F.lead("task").over(order), F.min("task").over(Window.partitionBy(F.lit(0)))).alias("then"))
    heads = ends.where("kind = 'head'").select(F.col("task").alias("then"), F.col("text").alias("following"))
    seams = ends.where("kind = 'last'").select("doc_id", "text", "task").join(following, "task").join(heads, "then").select("doc_id", "text", "following")

    def sew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc, text, then in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows.append(_row(doc, text, fingerprint(_words(text, hashes)), then, fingerprint(_words(then, hashes)), hashes))
            yield pa.RecordBatch.from_arrays(_batch(rows, 7), names)

    return made.where("kind = 'done'").select(*names).unionByName(seams.mapInArrow(sew, RESULT))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                marks = [fingerprint(_words(x or "", hashes)).hex() for x in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(marks, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _halves(mark: str) -> list:
    """The two halves of a hex fingerprint as longs."""
    return [F.conv(F.substring(mark, k, 16), 16, -10).cast("long") for k in (1, 17)]


def _entries(marks: DataFrame, radius: int, agree: int) -> DataFrame:
    """An entry for each permuted table: the table's number and the blocks that it puts in front."""
    count = radius + agree
    cuts = [round(BITS * k / count) for k in range(count + 1)]

    def block(k: int):
        bits = []
        for half, start in (("hi", 0), ("lo", 64)):
            lo, hi = max(cuts[k] - start, 0), min(cuts[k + 1] - start, 64)
            if lo < hi:
                bits.append(F.shiftrightunsigned(F.shiftleft(F.col(half), lo), 64 - (hi - lo)))
        return bits

    tables = [F.struct(F.lit(n).alias("n"), F.xxhash64(*(b for k in chosen for b in block(k))).alias("front")) for n, chosen in enumerate(combinations(range(count), agree))]
    return marks.withColumn("entry", F.explode(F.array(*tables)))


def search(queries: DataFrame, marks: DataFrame, radius: int = RADIUS, agree: int = 1) -> DataFrame:
    """All pairs (query, fingerprint, distance) within ``radius`` bits, a fingerprint itself included.

    Both tables have a column fingerprint and count as sets: copies are one row. The bits are cut into
    ``radius + agree`` blocks, of which two fingerprints within the radius share ``agree`` at least; there is one
    table for each choice of so many blocks. More agreement makes more but more selective tables.
    """
    hi, lo = _halves("fingerprint")
    q = _entries(queries.select("fingerprint").where("fingerprint IS NOT NULL").distinct().select(F.col("fingerprint").alias("query"), hi.alias("hi"), lo.alias("lo")), radius, agree)
    m = _entries(marks.select("fingerprint").where("fingerprint IS NOT NULL").distinct().select("fingerprint", hi.alias("hi"), lo.alias("lo")), radius, agree)
    distance = (F.bit_count(F.col("q.hi").bitwiseXOR(F.col("m.hi"))) + F.bit_count(F.col("q.lo").bitwiseXOR(F.col("m.lo")))).alias("distance")
    return q.alias("q").join(m.alias("m"), "entry").select("query", "fingerprint", distance).where(F.col("distance") <= radius).distinct()


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``with_next`` of all documents; n_near is, for each doc_id divisible by 50, the number of documents within the radius of its fingerprint (itself included), else null."""
    rows = materialize(with_next(docs), "simhash-rows")
    asked = rows.where("doc_id % 50 = 0").select("fingerprint")
    copies = rows.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    near = search(asked, copies).join(copies, "fingerprint").groupBy(F.col("query").alias("fingerprint")).agg(F.sum("copies").alias("n_near"))
    return rows.join(near, "fingerprint", "left").withColumn("n_near", F.when(F.col("doc_id") % 50 == 0, F.col("n_near"))).select(*rows.columns, "n_near")
