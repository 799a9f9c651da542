"""Segmentation by shortest paths, comparison of two tokenizations, acceptance checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import first_difference

#: Largest vocabulary that encoders broadcast; a vocabulary is small by nature, this proves it.
MOST_TOKENS = 2_000_000


def shortest(word: str, cost: dict[str, float], longest: int, unknown: str | None = None, unknown_cost: float = 1.0) -> list[str] | None:
    """Cheapest segmentation. Of equal paths to a place the one whose last token starts first wins.

    With ``unknown``, characters that no token covers cost ``unknown_cost`` each; else None where no path is.
    """
    n = len(word)
    best: list[float] = [0.0] + [float("inf")] * n
    back: list[tuple[int, str] | None] = [None] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            token = word[start:end]
            c = cost.get(token)
            if c is None:
                if unknown is None or end - start > 1:
                    continue
                token, c = unknown, unknown_cost
            if best[start] + c < best[end]:
                best[end], back[end] = best[start] + c, (start, token)
    if best[n] == float("inf"):
        return None
    out, at = [], n
    while at:
        at, token = back[at]
        out.append(token)
    return out[::-1]


def load_vocabulary(vocabulary: DataFrame, weight: str | None = None) -> dict[str, float]:
    """Tokens and their costs on the driver, after a check of the size."""
    rows = vocabulary.select("token", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("c")).limit(MOST_TOKENS + 1).collect()
    if len(rows) > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} tokens")
    return {r.token: r.c for r in rows}


def encode_words(counts: DataFrame, vocabulary: DataFrame, weight: str | None = None, unknown: str | None = None) -> DataFrame:
    """``counts`` (pretoken, ...) plus tokens (array; null where no path is): one segmentation for each distinct pretoken."""
    cost = load_vocabulary(vocabulary, weight)
    longest = max(map(len, cost), default=1)
    shared = counts.sparkSession.sparkContext.broadcast(cost)
    at = counts.columns.index("pretoken")
    from pyspark.sql import types as T

    schema = T.StructType([*counts.schema.fields, T.StructField("tokens", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            tokens = [shortest(w or "", table, longest, unknown) for w in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.list_(pa.string()))], [*batch.schema.names, "tokens"])

    return counts.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, pieces: Column, encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, position, token): tokens of each document, from its pretokens' segmentations by a join."""
    words = docs.select(key, F.posexplode(pieces).alias("word_place", "pretoken"))
    joined = words.join(encoded.select("pretoken", "tokens"), "pretoken")
    return joined.select(key, "word_place", F.posexplode("tokens").alias("token_place", "token"))


def document_tokens(docs: DataFrame, pieces: Column, encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens) of each document; texts without pretokens have 0."""
    words = docs.select(key, F.explode(pieces).alias("pretoken")).groupBy(key, "pretoken").agg(F.count("*").alias("n"))
    n = words.join(encoded.select("pretoken", F.size("tokens").alias("size")), "pretoken").groupBy(key).agg(F.sum(F.col("n") * F.col("size")).alias("n_tokens"))
    return docs.select(key).join(n, key, "left").select(key, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def compare(left: DataFrame, right: DataFrame, key: str = "pretoken") -> DataFrame:
    """Two tokenizations (key, tokens) of the same texts: sizes, change in percent, first difference."""
    joined = left.select(key, F.col("tokens").alias("a")).join(right.select(key, F.col("tokens").alias("b")), key)
    n, m = F.size("a"), F.size("b")
    return joined.select(
        key,
        n.alias("left_tokens"),
        m.alias("right_tokens"),
        (n - m).alias("delta"),
        F.when(m != 0, F.round(100.0 * (n - m) / m, 6)).when(n == 0, F.lit(0.0)).alias("delta_percent"),
        first_difference(F.col("a"), F.col("b")).alias("first_difference"),
    )


def aligned(left: Column, right: Column) -> Column:
    """Tokens of both side by side; the shorter one ends in nulls."""
    return F.arrays_zip(left.alias("left"), right.alias("right"))


def acceptance(spark, vocabulary: DataFrame, specials: list[str], unknown: str) -> DataFrame:
    """How a vocabulary treats the 256 single bytes: encodable, exact, unknown; and special tokens kept whole."""
    from tokenloom.functions.text import byte_level

    letters = spark.range(256).select(F.char(F.col("id")).alias("text"), "id").select(F.when(F.col("id") == 0, F.lit("\0")).otherwise(F.col("text")).alias("text"))
    symbols = letters.select("text", byte_level(F.col("text")).alias("pretoken"))
    encoded = encode_words(symbols, vocabulary, unknown=unknown)
    whole = vocabulary.where(F.col("token").isin(specials)).count()
    return encoded.agg(
        F.count("*").alias("inputs"),
        F.count_if(F.size("tokens") > 0).alias("encodable"),
        F.count_if((F.array_join("tokens", "") == F.col("pretoken")) & ~F.array_contains("tokens", unknown)).alias("exact"),
        F.count_if(F.size(F.filter("tokens", lambda t: t != unknown)) == 0).alias("all_unknown"),
    ).withColumn("special_tokens", F.lit(whole).cast("long"))
