"""Deterministic sampling. Random order is the order of md5(seed:key), which any engine can reproduce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import has_text
from tokenloom.operators.counting import dense_ids


def hash_key(seed: int | str, *keys) -> Column:
    """md5 of the seed and the keys, colon-separated."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def uniform(digest: Column) -> Column:
    """A number in (0, 1) from the first eight hex digits of a digest."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)


def equal_quotas(sources: list[str], n: int) -> dict[str, int]:
    """Split n rows evenly; what is left over goes to the first sources."""
    if not sources or len(set(sources)) != len(sources) or n <= 0:
        raise ValueError("sources must be distinct and not empty, and the number of rows positive")
    each, more = divmod(n, len(sources))
    return {s: each + (i < more) for i, s in enumerate(sources)}


def first_rows(docs: DataFrame, quotas: dict[str, int], source: str = "source", order: str = "doc_id") -> DataFrame:
    """Of each source the first rows with text, up to its quota; rows are ranked inside partitions first."""
    spark = docs.sparkSession
    table = spark.createDataFrame(list(quotas.items()), f"{source} string, quota long")
    rows = docs.where(has_text(F.col("text"))).join(F.broadcast(table), source)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(source).orderBy(order)))
    most = max(quotas.values(), default=0)
    return ranked.where(F.col("rank") <= most).where(F.col("rank") <= F.col("quota")).drop("quota")


def unfilled(sample: DataFrame, quotas: dict[str, int], source: str = "source") -> list[str]:
    """Sources that gave fewer rows than their quota."""
    got = {r[0]: r[1] for r in sample.groupBy(source).count().collect()}
    return [s for s, n in quotas.items() if got.get(s, 0) < n]


def hash_sample(rows: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """n rows without replacement."""
    return rows.orderBy(hash_key(seed, key), key).limit(n)


def two_tier_sample(docs: DataFrame, shards: int, n: int, seed: int, shard: str = "source", key: str = "doc_id") -> DataFrame:
    """n rows of ``shards`` shards, both chosen by hash order."""
    chosen = docs.select(shard).distinct().orderBy(hash_key(seed, shard), shard).limit(shards)
    return hash_sample(docs.join(chosen, shard, "left_semi"), n, seed, key)


def per_file_sample(docs: DataFrame, files: int, rows: int, seed: int, file: str = "source", key: str = "doc_id") -> DataFrame:
    """``rows`` documents of each of ``files`` files; null texts become empty. The seed moves on with the file's place."""
    places = docs.select(file).distinct().orderBy(hash_key(seed, file), file).limit(files)
    order = Window.partitionBy(F.lit(0)).orderBy(hash_key(seed, file), file)  # ``files`` rows
    places = places.withColumn("file_number", F.row_number().over(order) - 1)
    joined = docs.join(places, file).withColumn("file_seed", (F.lit(seed) + F.col("file_number") * 1000003).cast("string"))
    picked = Window.partitionBy(file).orderBy(F.md5(F.concat_ws(":", "file_seed", F.col(key).cast("string"))), key)
    ranked = joined.withColumn("rank", F.row_number().over(picked)).where(F.col("rank") <= rows)
    return ranked.select(file, "file_number", key, "rank", F.coalesce("text", F.lit("")).alias("text"))


def draw_counts(spark, sources: list[str], n: int, seed: int) -> DataFrame:
    """(source, rows) of n uniform draws over the sources; sources never drawn have 0."""
    names = F.array(*map(F.lit, sources))
    drawn = spark.range(n).select(F.get(names, F.floor(uniform(hash_key(seed, "id")) * len(sources)).cast("int")).alias("source"))
    every = spark.createDataFrame([(s,) for s in sources], "source string")
    return every.join(drawn.groupBy("source").agg(F.count("*").alias("rows")), "source", "left").select("source", F.coalesce("rows", F.lit(0)).alias("rows"))


def draw_sample(docs: DataFrame, counts: DataFrame, seed: int, source: str = "source", file: str = "file", key: str = "doc_id") -> DataFrame:
    """Draw files with replacement from each source and take rows of each draw in its own order until the
    source's count is reached. A row can come back with another draw. Sources to draw from must have rows."""
    sizes = docs.groupBy(source, file).agg(F.count("*").alias("size"))
    place = F.row_number().over(Window.partitionBy(source).orderBy(file)) - 1  # a row a file
    files = sizes.withColumn("place", place).withColumn("files", F.count("*").over(Window.partitionBy(source)))
    wanted = counts.where("rows > 0")
    none = [r[0] for r in wanted.join(sizes, source, "left_anti").select(source).limit(10).collect()]
    if none:
        raise ValueError(f"no rows to draw from in {none}")
    # so many draws fill the count even if each hits the smallest file; windows over draws, not over rows
    draws = F.ceil(F.col("rows") / F.col("least")).cast("int")
    least = files.groupBy(source).agg(F.first("files").alias("files"), F.min("size").alias("least"))
    tries = wanted.join(least, source).withColumn("draw", F.explode(F.sequence(F.lit(0), draws - 1))).drop("least")
    tries = tries.withColumn("place", F.floor(uniform(hash_key(seed, source, "draw")) * F.col("files")).cast("int")).join(files.select(source, "place", file, "size"), [source, "place"])
    before = F.coalesce(F.sum("size").over(Window.partitionBy(source).orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = tries.withColumn("before", before).where(F.col("before") < F.col("rows")).withColumn("take", F.least("size", F.col("rows") - F.col("before")))
    order = Window.partitionBy(source, "draw").orderBy(hash_key(seed, source, "draw", key), key)
    rows = docs.join(used.select(source, file, "draw", "take"), [source, file]).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= F.col("take")).drop("take")


def thin_tokens(docs: DataFrame, pieces: Column, keep: float, replicas: int, seed: int, key: str = "doc_id") -> DataFrame:
    """Copies of each text in which every piece stays with probability ``keep``; pieces are joined by spaces, empty copies go."""
    copies = docs.select(key, pieces.alias("_pieces"), F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica"))
    digest = lambda i: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replica").cast("string"), F.col(key).cast("string"), i.cast("string")))
    marked = F.transform("_pieces", lambda p, i: F.struct(p.alias("p"), (uniform(digest(i)) < keep).alias("stays")))
    text = F.array_join(F.transform(F.filter(marked, lambda x: x["stays"]), lambda x: x["p"]), " ")
    return copies.select(key, "replica", text.alias("text")).where(F.length(F.trim("text")) > 0)


def char_cap(docs: DataFrame, most: int, order: str = "doc_id") -> DataFrame:
    """Rows in order until the characters reach ``most``; the row that crosses it is the last."""
    sized = docs.withColumn("_chars", F.coalesce(F.length("text"), F.lit(0)))
    return dense_ids(sized, [order], "_rank", {"chars_before": "_chars"}).where(F.col("chars_before") < most).drop("_chars", "_rank")


def chunks(docs: DataFrame, size: int, order: str = "doc_id") -> DataFrame:
    """Consecutive chunks of ``size`` rows."""
    return dense_ids(docs, [order], "_rank").withColumn("chunk", F.floor(F.col("_rank") / size)).drop("_rank")


def merge_chunks(vocabularies: DataFrame) -> DataFrame:
    """Sum of lp_value for each token over the vocabularies of all chunks."""
    return vocabularies.groupBy("token").agg(F.sum("lp_value").alias("lp_value"))
