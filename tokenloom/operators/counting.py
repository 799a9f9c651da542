"""Pretoken and candidate counting, distributed ranks, histograms, adjacent-pair statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import byte_level, split, substrings
from tokenloom.operators import prefixes
from tokenloom.session import materialize


def pretokens(docs: DataFrame, mode: str = "nanochat", text: str = "text") -> DataFrame:
    """One row for each pretoken occurrence (raw characters); null texts give none."""
    return docs.select(F.explode(split(text, mode)).alias("word")).where("word <> ''")


def pretoken_counts(docs: DataFrame, mode: str = "nanochat", text: str = "text") -> DataFrame:
    """(pretoken, frequency). Raw pieces are counted first and turned into symbols once for each distinct one."""
    counted = pretokens(docs, mode, text).groupBy("word").agg(F.count("*").alias("frequency"))
    return counted.select(byte_level(F.col("word")).alias("pretoken"), "frequency")


def corpus_size(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.agg(F.count(text).alias("texts"), F.sum(F.length(text)).cast("long").alias("chars"), F.sum(F.octet_length(text)).cast("long").alias("bytes"))


def occurrences(counts: DataFrame, most: int | None = None, least: int = 2) -> DataFrame:
    """One row for each substring occurrence of each pretoken: pretoken, frequency, start, end, token."""
    rows = counts.where(F.length("pretoken") >= least)
    return rows.select("pretoken", "frequency", F.explode(substrings(F.col("pretoken"), least, most)).alias("e")).select("pretoken", "frequency", "e.start", "e.end", "e.token")


def candidate_counts(counts: DataFrame, more_than: int = 1, most: int | None = None) -> DataFrame:
    """(token, count): substrings weighted by pretoken frequency; counts at or below ``more_than`` go."""
    return prefixes.substring_totals(counts, more_than, 2, most)


def raw_graph_size(counts: DataFrame, most: int | None = None) -> DataFrame:
    """Edges, unit edges and vertices of all pretoken graphs in closed form, without making them."""
    n = F.length("pretoken").cast("long")
    top = n if most is None else F.least(n, F.lit(most))
    edges = F.when(top >= 2, (top - 1) * (n + 1) - (top * (top + 1) / 2 - 1)).otherwise(0)
    return counts.agg(F.sum(edges).cast("long").alias("raw_edges"), F.sum(n).cast("long").alias("free_edges"), F.sum(n + 1).cast("long").alias("vertices"))


def histogram(tokens: DataFrame, size: int = 1000, count: str = "count") -> DataFrame:
    """(bucket, tokens): tokens by count, in buckets of equal width."""
    return tokens.groupBy((F.floor(F.col(count) / size) * size).cast("long").alias("bucket")).agg(F.count("*").alias("tokens"))


def dense_ids(rows: DataFrame, order: list, name: str, totals: dict[str, str] | None = None) -> DataFrame:
    """Number rows from 0 in a global order without gathering them in one task.

    Rows are partitioned by range; each is numbered inside its partition and moved on by the rows of the
    partitions before. ``totals`` maps a result column to a column whose sum over all earlier rows it gets.
    """
    totals = totals or {}
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_sum_{k}") for k, c in totals.items()))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sums = {"_n": "_n0", **{f"_sum_{k}": f"_sum0_{k}" for k in totals}}
    offsets = parts.select("_part", *(F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(b) for a, b in sums.items()))
    inside = Window.partitionBy("_part").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.select("*", (F.row_number().over(inside) - 1).cast("long").alias("_i"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_in_{k}") for k, c in totals.items()))
    joined = numbered.join(offsets, "_part")
    return joined.select(*rows.columns, (F.col("_i") + F.col("_n0")).alias(name), *((F.col(f"_in_{k}") + F.col(f"_sum0_{k}")).alias(k) for k in totals))


def token_ids(candidates: DataFrame) -> DataFrame:
    """(token_id, token, count): ids by code point order of the kept tokens."""
    return dense_ids(materialize(candidates.select("token", "count"), "candidates"), ["token"], "token_id")


def edges(counts: DataFrame, tokens: DataFrame, most: int | None = None) -> DataFrame:
    """Edges of the pretoken graphs: occurrences of kept tokens with their id and the pretoken's frequency."""
    return occurrences(counts, most).join(tokens.select("token", "token_id"), "token").select("pretoken", "frequency", "start", "end", "token_id", "token")


def graph_summary(counts: DataFrame, most: int | None = None) -> DataFrame:
    """For each pretoken, by code point order: id, vertices, unit edges, edges, and offsets of all three.

    Edges stand for the substrings that occur more than once; they are counted, not made.
    """
    n = prefixes.edge_counts(counts, 2, most)
    rows = counts.join(n, "pretoken", "left").select("pretoken", "frequency", (F.length("pretoken") + 1).cast("long").alias("vertices"), F.length("pretoken").cast("long").alias("free_edges"), F.coalesce("edges", F.lit(0)).alias("edges"))
    return dense_ids(rows, ["pretoken"], "pretoken_id", {"vertex_offset": "vertices", "free_offset": "free_edges", "edge_offset": "edges"})


def runs(symbols: Column) -> Column:
    """Adjacent pairs of an array as merges would take them: in a run of equal symbols every second pair counts."""
    n = F.size(symbols)
    # length of the run of equal symbols that ends at i
    run = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        F.struct(F.lit(0).alias("run"), F.array().cast("array<struct<l:string,r:string>>").alias("out")),
        lambda a, i: F.when(
            i < n,
            F.struct(
                F.when(F.get(symbols, i) == F.get(symbols, i - 1), a["run"] + 1).otherwise(0).alias("run"),
                F.when((F.get(symbols, i) == F.get(symbols, i - 1)) & (a["run"] % 2 == 1), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(F.get(symbols, i - 1).alias("l"), F.get(symbols, i).alias("r"))))).alias("out"),
            ),
        ).otherwise(a),
        lambda a: a["out"],
    )
    return F.when(n >= 2, run).otherwise(F.array().cast("array<struct<l:string,r:string>>"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, count, sequences) of adjacent symbols in ``words`` (symbols, frequency)."""
    found = words.select("frequency", runs(F.col("symbols")).alias("all"))
    each = F.transform(F.array_distinct("all"), lambda p: F.struct(p["l"].alias("l"), p["r"].alias("r"), F.size(F.filter("all", lambda q: q == p)).alias("n")))
    rows = found.select("frequency", F.explode(each).alias("p"))
    return rows.groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum(F.col("frequency") * F.col("p.n")).alias("count"), F.count("*").alias("sequences"))


def single_counts(words: DataFrame) -> DataFrame:
    """(symbol, count) over ``words`` (symbols, frequency)."""
    return words.select("frequency", F.explode("symbols").alias("symbol")).groupBy("symbol").agg(F.sum("frequency").alias("count"))


def whole_words(words: DataFrame) -> DataFrame:
    """Occurrences of words that are one symbol, and of all words."""
    return words.agg(F.sum(F.when(F.size("symbols") == 1, F.col("frequency")).otherwise(0)).alias("whole_words"), F.sum("frequency").alias("words"))


def matches(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences of vocabulary tokens in pretokens, single characters included. An empty vocabulary is an error."""
    if not vocabulary.limit(1).count():
        raise ValueError("the vocabulary is empty")
    return occurrences(counts, least=1).join(vocabulary.select("token").distinct(), "token", "left_semi")


def extend_free(made: DataFrame, accepted: DataFrame) -> DataFrame:
    """Edges with a column free: whether their token is accepted."""
    chosen = accepted.select("token").distinct().withColumn("_in", F.lit(True))
    return made.join(chosen, "token", "left").withColumn("free", F.coalesce("_in", F.lit(False))).drop("_in")


def free_and_other_edges(counts: DataFrame, accepted: DataFrame, most: int | None = None) -> DataFrame:
    """(pretoken, free_edges, other_edges) of pretokens with edges, for a few accepted tokens that occur more than once.

    Only the accepted tokens' occurrences are made; the others are what is left of all edges.
    """
    chosen = accepted.select("token").distinct()
    longest = chosen.agg(F.max(F.length("token"))).first()[0] or 0
    n = F.length("pretoken")
    sizes = F.explode(F.sequence(F.lit(2), F.least(n, F.lit(min(longest, most or longest))))).alias("size")
    starts = counts.where((n >= 2) & F.lit(longest >= 2)).select("pretoken", sizes).select("pretoken", "size", F.explode(F.sequence(F.lit(0), n - F.col("size"))).alias("start"))
    found = starts.select("pretoken", F.substring(F.col("pretoken"), F.col("start") + 1, F.col("size")).alias("token"))
    free = found.join(F.broadcast(chosen), "token", "left_semi").groupBy("pretoken").agg(F.count("*").alias("free_edges"))
    rows = prefixes.edge_counts(counts, 2, most).where("edges > 0").join(free, "pretoken", "left")
    free_edges = F.coalesce("free_edges", F.lit(0))
    return rows.select("pretoken", free_edges.alias("free_edges"), (F.col("edges") - free_edges).alias("other_edges"))


def instance_counts(tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """(token, count) of given tokens; -1 for tokens that aren't candidates."""
    return tokens.select("token").distinct().join(candidates.select("token", "count"), "token", "left").select("token", F.coalesce("count", F.lit(-1)).cast("long").alias("count"))
