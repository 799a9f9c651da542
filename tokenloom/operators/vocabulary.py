"""Vocabulary selection: frequent pretokens, rounding of fractional vocabularies, overlap between vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import ALPHABET
from tokenloom.operators.sampling import hash_key, uniform
from tokenloom.session import materialize


def best(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows in order, with rank from 1. Only n rows meet in one task."""
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def frequent(counts: DataFrame, size: int, reserved: list[str] | None = None) -> DataFrame:
    """(id, token): reserved tokens, then the most frequent pretokens; ties by code point. May stay short."""
    reserved = ALPHABET if reserved is None else reserved
    if size < len(reserved):
        raise ValueError(f"a vocabulary of {size} can't hold {len(reserved)} reserved tokens")
    spark = counts.sparkSession
    fixed = spark.createDataFrame(list(enumerate(reserved)), "id long, token string")
    rest = counts.select(F.col("pretoken").alias("token"), "frequency").join(F.broadcast(fixed.select("token")), "token", "left_anti")
    ranked = best(rest, size - len(reserved), [F.desc("frequency"), F.asc("token")])
    return fixed.unionByName(ranked.select((F.col("rank") + len(reserved) - 1).cast("long").alias("id"), "token"))


def _with_alphabet(chosen: DataFrame, alphabet: list[str], specials: list[str]) -> DataFrame:
    fixed = [*specials, *sorted(set(alphabet))]
    table = chosen.sparkSession.createDataFrame(list(enumerate(fixed)), "id long, token string")
    tokens = chosen.join(F.broadcast(table.select("token")), "token", "left_anti")
    order = Window.partitionBy(F.lit(0)).orderBy("rank")
    return table.unionByName(tokens.select((F.row_number().over(order) + len(fixed) - 1).cast("long").alias("id"), "token"))


def _budget(size: int, alphabet: list[str], specials: list[str]) -> int:
    left = size - len(set(alphabet)) - len(specials)
    if left <= 0:
        raise ValueError(f"vocabulary size {size} leaves no room beside the alphabet and special tokens")
    return left


def all_ones(lp: DataFrame, alphabet: list[str], specials: list[str] = (), least: float = 0.99) -> DataFrame:
    """Every token whose value is at least ``least``."""
    specials = list(specials)
    rank = Window.partitionBy(F.lit(0)).orderBy(F.desc("lp_value"), "token_id")  # tokens at 1: a vocabulary
    return _with_alphabet(lp.where(F.col("lp_value") >= least).withColumn("rank", F.row_number().over(rank)), alphabet, specials)


def deterministic(lp: DataFrame, size: int, alphabet: list[str], specials: list[str] = ()) -> DataFrame:
    """The tokens with the greatest values, ties by token id."""
    specials = list(specials)
    return _with_alphabet(best(lp, _budget(size, alphabet, specials), [F.desc("lp_value"), F.asc("token_id")]), alphabet, specials)


def biased(lp: DataFrame, size: int, alphabet: list[str], specials: list[str] = ()) -> DataFrame:
    """Tokens of positive value, by value divided by length."""
    specials = list(specials)
    keyed = lp.where("lp_value > 0").withColumn("_key", F.col("lp_value") / F.length("token"))
    return _with_alphabet(best(keyed, _budget(size, alphabet, specials), [F.desc("_key"), F.asc("token_id")]), alphabet, specials)


def probabilistic(lp: DataFrame, size: int, alphabet: list[str], seed: int, specials: list[str] = (), sure: float = 0.99, strict: bool = True) -> DataFrame:
    """All tokens above ``sure``, the rest drawn without replacement in proportion to their values (Gumbel top-k).

    More tokens above ``sure`` than there is room for are an error; if not ``strict``, the first by value and token id fill it.
    """
    specials = list(specials)
    left = _budget(size, alphabet, specials)
    lp = materialize(lp, "values")  # it is read three times
    certain = lp.where(F.col("lp_value") > sure)
    n = certain.count()
    if n > left and not strict:
        return _with_alphabet(best(certain, left, [F.desc("lp_value"), F.asc("token_id")]), alphabet, specials)
    if n > left:
        raise ValueError(f"{n} tokens are above {sure}; there is room for {left}")
    u = uniform(hash_key(seed, "token_id"))
    keyed = lp.where((F.col("lp_value") <= sure) & (F.col("lp_value") > 0)).withColumn("_key", F.log("lp_value") - F.log(-F.log(u)))
    drawn = best(keyed, left - n, [F.desc("_key"), F.asc("token_id")])
    first = best(certain, left, [F.desc("lp_value"), F.asc("token_id")])
    chosen = first.select("token", "rank").unionByName(drawn.select("token", (F.col("rank") + n).alias("rank")))
    return _with_alphabet(chosen, alphabet, specials)


def support(lp: DataFrame, above: float = 0.0) -> DataFrame:
    """Tokens whose value is above a bound, without rounding."""
    return lp.where(F.col("lp_value") > above)


def top_tokens(candidates: DataFrame, n: int) -> DataFrame:
    """The n tokens with most occurrences, ties by code point, with their rank."""
    return best(candidates, n, [F.desc("count"), F.asc("token")]).select("rank", "token", "count")


def check_size(vocabulary: DataFrame, size: int) -> None:
    n = vocabulary.select("token").distinct().count()
    if n != size:
        raise ValueError(f"the vocabulary has {n} distinct tokens instead of {size}; there may be too few candidates")


# Overlap. Vocabularies are rows (sample, token); tokens of a sample count once.


def _sides(vocabularies: DataFrame) -> DataFrame:
    return vocabularies.select("sample", "token").distinct()


def _shared(own: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs i < j with the number of tokens they share. A token meets itself in other samples only."""
    left = own.select(F.col("sample").alias("sample_i"), *[k for k in keys], "token")
    right = own.select(F.col("sample").alias("sample_j"), "token")
    return left.join(right, "token").where("sample_i < sample_j").groupBy("sample_i", "sample_j", *keys).agg(F.count("*").alias("shared"))


def _pairs(samples: DataFrame) -> DataFrame:
    """All pairs i < j of samples: a few rows, one for each pair of vocabularies."""
    names = samples.agg(F.sort_array(F.collect_set("sample")).alias("s"))
    return names.select(F.explode("s").alias("sample_i"), "s").select("sample_i", F.explode("s").alias("sample_j")).where("sample_i < sample_j")


def jaccard_pairs(vocabularies: DataFrame) -> DataFrame:
    """(sample_i, sample_j, jaccard) for i < j; two empty vocabularies give 0."""
    own = _sides(vocabularies)
    size = own.groupBy("sample").agg(F.count("*").alias("n"))
    pairs = _pairs(size).join(_shared(own, []), ["sample_i", "sample_j"], "left")
    for side in "ij":
        pairs = pairs.join(F.broadcast(size.select(F.col("sample").alias(f"sample_{side}"), F.col("n").alias(f"n_{side}"))), f"sample_{side}")
    shared = F.coalesce("shared", F.lit(0))
    return pairs.select("sample_i", "sample_j", F.coalesce(F.try_divide(shared, F.col("n_i") + F.col("n_j") - shared), F.lit(0.0)).alias("jaccard"))


def jaccard_matrix(pairs: DataFrame) -> DataFrame:
    """Symmetric matrix in long form; the diagonal is 0."""
    flipped = pairs.select(F.col("sample_j").alias("sample_i"), F.col("sample_i").alias("sample_j"), "jaccard")
    ends = pairs.select("sample_i").unionByName(pairs.select(F.col("sample_j").alias("sample_i"))).distinct()
    return pairs.unionByName(flipped).unionByName(ends.select("sample_i", F.col("sample_i").alias("sample_j"), F.lit(0.0).alias("jaccard")))


def jaccard_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.round(F.avg("jaccard"), 9).alias("mean"), F.min("jaccard").alias("min"), F.max("jaccard").alias("max"), F.count("*").alias("pairs"))


def jaccard_by_length(vocabularies: DataFrame) -> DataFrame:
    """(sample_i, sample_j, token_length, jaccard) for each length that one of both has."""
    own = _sides(vocabularies).withColumn("token_length", F.length("token"))
    size = own.groupBy("sample", "token_length").agg(F.count("*").alias("n"))
    shared = _shared(own, ["token_length"])
    pairs = _pairs(size)
    sides = [pairs.join(size.select(F.col("sample").alias(f"sample_{s}"), "token_length", F.col("n").alias(f"n_{s}")), f"sample_{s}") for s in "ij"]
    joined = sides[0].join(sides[1], ["sample_i", "sample_j", "token_length"], "full").join(shared, ["sample_i", "sample_j", "token_length"], "left")
    both = F.coalesce("n_i", F.lit(0)) + F.coalesce("n_j", F.lit(0))
    k = F.coalesce("shared", F.lit(0))
    return joined.select("sample_i", "sample_j", "token_length", (k / (both - k)).alias("jaccard"))
