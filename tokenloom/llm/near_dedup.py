"""Near-duplicate documents by a chosen-path similarity join (CPSJoin).

A document's set holds its distinct shingles of three words (A-Z lower-cased, words are runs without
ASCII white space); with fewer words, the whole sequence is its one shingle; without words the set is
empty and linked with nothing. Two documents are linked when ``100 * |A n B| >= threshold * |A u B|``.

1. Equal sets become one class. Each document gives one row: id, set size, a 128-bit hash of its set,
   minwise tokens (``trees * depth``) and a sketch of 32 bytes. The copies of a class are never paired.
2. In each of ``trees`` independent trees a class walks down the path of its chosen minwise tokens. A
   node of at most ``leaf`` classes is compared exhaustively by sketch; a larger one is branched by the
   next token and, since its classes agree on all tokens so far, also linked as a star around its
   smallest class. Sketches only spare hopeless pairs: a pair at the threshold fails the sketch
   test about once in 1e5.
3. Candidates are confirmed on the full sets, in two steps. First each class with its smallest
   candidate; then, of the rest, the pairs that still join different components. Pairs inside one
   component can change nothing and aren't read. Components come from min-label contraction.
4. Nodes that are still large at full depth are compared whole, in blocks of classes: every pair of
   different components, by sketch and then on full sets. A node whose stars have linked it costs nothing;
   one of n classes with m outside the component of its smallest costs n * m sketch comparisons.

Recall: a tree that compares at depth d meets a pair of similarity s with probability s^d; with 14
trees a pair at 0.85 is missed with 0.4^14 < 1e-5 at depth 3, and with 0.56^14 < 3e-4 where all its nodes
are large down to depth 5. The star edges add to that.

Null text or a text without words: n_shingles 0, its own component. Null doc_ids are dropped from the
links and returned as their own component. Rows that repeat a doc_id are one document that is linked
through each of its texts: if 6 has the texts A and B, a copy of A and a copy of B are in its component.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm._common import WordHashes, as_bytes, blocks, materialize, mix

THRESHOLD = 85
WIDTH = 3
TREES = 14
DEPTH = 5
LEAF = 24
SKETCH = 32
#: Of the sketch's bytes so many must agree: 4.5 standard deviations below the mean at the threshold.
AGREE = 18
#: Classes of a large node that meet others in one block; bounds memory, never what is compared.
BLOCK = 512
#: Ids of candidates that are broadcast at most (8 bytes each); more are joined by a shuffle.
MOST_SENT = 1_000_000


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; ``words`` holds word hashes."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : n - width + 1 + k])
    return np.unique(h)


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minwise(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The smallest token under each seed's order (its rank, 32 bits)."""
    best = np.full(len(seeds), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(tokens), 2048):
        part = tokens[None, at : at + 2048] * seeds[:, None]
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(best, (part >> np.uint64(32)).astype(np.uint32).min(1), out=best)
    return best


def signatures(docs: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, set (16 bytes; null if empty), path (4 bytes a level), sketch; no shuffle."""
    seeds = _seeds(trees * depth + SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in blocks(batches):
            n, sets, paths, sketches = [], [], [], []
            for text in as_bytes(batch.column(1)):
                tokens = shingles(hashes.of(text.lower().split()))
                n.append(len(tokens))
                if not len(tokens):
                    sets.append(None), paths.append(None), sketches.append(None)
                    continue
                best = minwise(tokens, seeds)
                sets.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                paths.append(best[: trees * depth].tobytes())
                sketches.append((best[trees * depth :] >> np.uint32(7)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (sets, paths, sketches))], ["doc_id", "n_shingles", "set", "path", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set binary, path binary, sketch binary")


def _pairs_in_nodes(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) in leaf nodes; ``rows`` has members, at most LEAF structs (id, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            column = batch.column(0)
            offsets = column.offsets.to_numpy()
            members = column.values
            ids = members.field("id").to_numpy()
            sketches = np.frombuffer(b"".join(members.field("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if e - s == 2:
                    if np.count_nonzero(sketches[s] == sketches[s + 1]) >= AGREE:
                        left.append([min(ids[s], ids[s + 1])]), right.append([max(ids[s], ids[s + 1])])
                    continue
                order = s + np.argsort(ids[s:e])
                own, name = sketches[order], ids[order]
                same = (own[:, None, :] == own[None, :, :]).sum(2)
                x, y = np.nonzero(np.triu(same >= AGREE, 1))
                left.append(name[x]), right.append(name[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z) if z else [], pa.int64()) for z in (left, right)], ["a", "b"])

    return rows.select("members").mapInArrow(run, "a long, b long")


def _token(column: str, at):
    """Four bytes of the path as an integer."""
    return F.conv(F.hex(F.substring(column, at * 4 + 1, 4)), 16, 10).cast("long")


def candidates(classes: DataFrame, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a, b), a < b, of ``classes`` (id, path, sketch).

    Also the members (node, id, sketch) of nodes still large at full depth, of which only stars are paired.
    """

    def enter(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                names = batch.schema.names
                paths = np.frombuffer(b"".join(batch.column(names.index("path")).to_pylist()), np.uint32)
                if level == 0:
                    paths = paths.reshape(n, trees, depth)
                    node = mix(np.arange(1, trees + 1, dtype=np.uint64)[None, :] << np.uint64(32) ^ paths[:, :, 0].astype(np.uint64)).reshape(-1)
                    at = np.repeat(np.arange(n), trees)
                    rest = np.ascontiguousarray(paths[:, :, 1:]).reshape(n * trees, -1)
                else:
                    paths = paths.reshape(n, -1)
                    node = mix(batch.column(names.index("node")).to_numpy().view(np.uint64) * np.uint64(31) + paths[:, 0].astype(np.uint64))
                    at, rest = np.arange(n), np.ascontiguousarray(paths[:, 1:])
                width = rest.shape[1] * 4
                raw = rest.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index("id")).take(pa.array(at)), pa.array(node.view(np.int64)), pa.array([raw[i * width : (i + 1) * width] for i in range(len(at))], pa.binary()), batch.column(names.index("sketch")).take(pa.array(at))],
                    ["id", "node", "path", "sketch"],
                )

        return run

    schema = "id long, node long, path binary, sketch binary"
    sketches = classes.select(F.col("id").alias("low"), F.col("sketch").alias("low_sketch"))
    found: DataFrame | None = None
    rows = classes.select("id", "path", "sketch").mapInArrow(enter(0), schema)
    for level in range(depth):
        size = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 1")
        met = materialize(rows.join(size.hint("merge"), "node"), "near-nodes")
        large = met.where(F.col("n") > leaf)
        small = met.where(F.col("n") <= leaf).groupBy("node").agg(F.collect_list(F.struct("id", "sketch")).alias("members"))
        stars = large.where("id <> low").select("low", "id", "sketch").join(sketches.join(large.select("low").distinct(), "low", "left_semi"), "low")
        pairs = _pairs_in_nodes(small).unionByName(_alike(stars))
        found = pairs if found is None else found.unionByName(pairs)
        if level < depth - 1:
            rows = large.select("id", "node", "path", "sketch").mapInArrow(enter(level + 1), schema)
        if not large.limit(1).count():
            break
    return found.distinct(), large.select("node", "id", "sketch")


def pairs_across(members: DataFrame, label: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ``members`` (node, id, sketch) that share a node, not a component, and agree.

    In each node the classes outside the component of its smallest one meet all its classes, a block of the
    ones with a block of the others at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            column = batch.column(0)
            offsets = column.offsets.to_numpy()
            rows = column.values
            ids, kind = rows.field("id").to_numpy(), rows.field("component").to_numpy()
            outer = rows.field("outer").to_numpy(zero_copy_only=False)
            sketches = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                x, y = s + np.flatnonzero(outer[s:e]), s + np.flatnonzero(~outer[s:e])
                same = np.zeros((len(x), len(y)), np.uint8)
                for k in range(SKETCH):
                    same += sketches[x, k][:, None] == sketches[y, k][None, :]
                i, j = np.nonzero((same >= AGREE) & (kind[x][:, None] != kind[y][None, :]))
                left.append(np.minimum(ids[x[i]], ids[y[j]])), right.append(np.maximum(ids[x[i]], ids[y[j]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z) if z else [], pa.int64()) for z in (left, right)], ["a", "b"])

    rows = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rows.groupBy("node").agg(F.min_by("component", "id").alias("main"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    rows = materialize(rows.join(mixed.select("node", "main").hint("merge"), "node"), "near-mixed")
    blocks_of = lambda n: F.ceil(n / F.lit(block)).cast("int")
    size = rows.groupBy("node").agg(blocks_of(F.count("*")).alias("ys"), blocks_of(F.count_if(F.col("component") != F.col("main"))).alias("xs"))
    rows = rows.join(size.hint("merge"), "node")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = rows.where("component <> main").select("node", own("xs").alias("x"), every("ys").alias("y"), "id", "component", "sketch", F.lit(True).alias("outer"))
    inner = rows.select("node", every("xs").alias("x"), own("ys").alias("y"), "id", "component", "sketch", F.lit(False).alias("outer"))
    met = outer.unionByName(inner).groupBy("node", "x", "y").agg(F.collect_list(F.struct("id", "component", "sketch", "outer")).alias("members"))
    return met.select("members").mapInArrow(run, "a long, b long").distinct()


def _alike(stars: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``stars`` (low, id, sketch, low_sketch) whose sketches agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, low = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((own == low).sum(1) >= AGREE)).rename_columns(["a", "b"])

    return stars.select("low", "id", "sketch", "low_sketch").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of class representatives that are linked, decided on full sets made from the texts.

    Sets travel first as 32-bit token hashes, repeats included, with the exact set size. What two such
    multisets share is never less than what the sets share, so a pair that fails on them is no link. It may be
    more, by chance: pairs that wouldn't pass with ``slack`` fewer shared tokens go again with 64 bits.
    """
    first = materialize(_decide(pairs, docs, threshold, wide=False), "near-decided")
    unsure = first.where("NOT sure").select("a", "b")
    return first.where("sure").select("a", "b").unionByName(_decide(unsure, docs, threshold, wide=True).select("a", "b"))


def slack(m: int, n: int) -> float:
    """More 32-bit hashes than this aren't shared by chance between sets of m and n: six deviations above the mean."""
    mean = m * n / 2.0**32
    return mean + 6 * mean**0.5 + 6


def shared_tokens(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    if not ((x[1:] == x[:-1]).any() or (y[1:] == y[:-1]).any()):
        both = np.concatenate((x, y))
        both.sort(kind="stable")
        return int(np.count_nonzero(both[1:] == both[:-1]))
    (u, k), (v, n) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(k[i], n[j]).sum())


def _decide(pairs: DataFrame, docs: DataFrame, threshold: int, wide: bool) -> DataFrame:
    kind = np.uint64 if wide else np.uint32
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-ids")
    # few ids are sent to the texts; of many, both sides are shuffled
    few = ids.count() <= MOST_SENT
    sets = token_sets(docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi"), wide)
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("tokens").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("n"), F.col("tokens").alias("y"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "m", "n", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sure = [], []
            for m, n, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                shared = 0
                if 100 * min(m, n) >= threshold * max(m, n):
                    shared = shared_tokens(*(np.frombuffer(z.as_buffer(), kind) for z in (x, y)))
                keep.append(100 * shared >= threshold * (m + n - shared))
                shared -= 0 if wide else slack(m, n)
                sure.append(100 * shared >= threshold * (m + n - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sure, pa.bool_())], ["a", "b", "sure"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long, sure boolean")


def token_sets(docs: DataFrame, wide: bool = True) -> DataFrame:
    """Full sets of documents: id, n (set size), tokens (sorted hashes, 8 or 4 bytes each; those of 4 may repeat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in blocks(batches):
            sets = [shingles(hashes.of(text.lower().split())) for text in as_bytes(batch.column(1))]
            n = [len(s) for s in sets]
            if not wide:
                sets = [(s >> np.uint64(32)).astype(np.uint32) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, n long, tokens binary")


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id for each node of ``edges`` (a, b): id, component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until every edge is a star around
    its smallest node. A step groups by node and takes minima only, so no neighbourhood is collected.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "near-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: greater neighbours of a move to a's smallest
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct()
        # small star: a and its smaller neighbours move to the smallest of them
        down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("m").alias("a"), "b").unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        edges = materialize(small, "near-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
        before = now


def _labelled(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """``pairs`` with the components of both ends."""
    for end in ("a", "b"):
        pairs = pairs.join(label.select(F.col("id").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs


def near_dedup(docs: DataFrame, threshold: int = THRESHOLD, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id (smallest doc_id with the same set), class_size."""
    docs = docs.select("doc_id", "text")
    rows = materialize(signatures(docs, trees, depth), "near-signatures")
    named = rows.where("doc_id IS NOT NULL AND set IS NOT NULL")
    # copies: one row a class; combines before the shuffle
    classes = materialize(named.groupBy("set").agg(F.min("doc_id").alias("id"), F.count("*").alias("class_size"), F.first("path").alias("path"), F.first("sketch").alias("sketch")), "near-classes")
    named = named.select("doc_id", "set")
    twice = named.groupBy("doc_id").agg(F.min("set").alias("x"), F.max("set").alias("y")).where("x <> y").select("doc_id")
    own = named.join(twice, "doc_id", "left_semi").join(classes.select("set", "id"), "set").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    own = materialize(own.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-own")
    pairs, crowded = candidates(classes.select("id", "path", "sketch"), trees, depth, leaf)
    pairs = materialize(pairs, "near-pairs")
    first = materialize(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "near-first")
    links = materialize(confirm(first, docs, threshold).unionByName(own), "near-links")
    rest = materialize(_labelled(pairs.join(first, ["a", "b"], "left_anti"), components(links)).where("ca <> cb").select("a", "b"), "near-rest")
    links = materialize(links.unionByName(confirm(rest, docs, threshold)), "near-links")
    label = components(links)
    if crowded.limit(1).count():
        across = materialize(pairs_across(crowded, label).join(pairs, ["a", "b"], "left_anti"), "near-across")
        label = components(links.unionByName(confirm(across, docs, threshold)))
    member = classes.join(label, "id", "left").select("set", F.col("id").alias("class_id"), "class_size", F.coalesce("component", "id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set").join(member, "set", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("class_id")), F.col("doc_id")).alias("class_id"), F.coalesce(F.col("class_size"), F.lit(1)).alias("class_size"))


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_dedup(docs)


ORACLE = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE
    WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i : i + {WIDTH} - 1], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
  FROM words),
classes AS MATERIALIZED (SELECT min(doc_id) AS id, count(*)::BIGINT AS class_size, s, len(s)::BIGINT AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS MATERIALIZED (SELECT id, n, unnest(s) AS t FROM classes),
links AS MATERIALIZED (
  SELECT x.id AS a, y.id AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.id <> y.id
  GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= {THRESHOLD} * (x.n + y.n - count(*))),
reached AS (SELECT id, id AS other FROM classes UNION SELECT reached.id, links.b FROM reached JOIN links ON links.a = reached.other),
component AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept,
       coalesce(classes.id, doc_id) AS class_id, coalesce(class_size, 1)::BIGINT AS class_size
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN component ON classes.id = component.id
"""
