"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but the last
return the columns of documents; ``run`` writes every stage's result as Parquet into the folder that
the executors share and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import line_dedup, near_dedup, packing, quality_rules, toxicity
from tokenloom.llm._common import documents, materialize
from tokenloom.session import ship


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    model = quality_rules.train(docs, documents(spark, sf_dir, "labels"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    own = F.struct(*rest) if rest else F.lit(None)  # without the text, which goes to Python and back once
    done = quality_rules.judge(docs.select("text", own.alias("_own")), model).where("kept")
    return done.select(*(F.col("text") if c == "text" else F.col(f"_own.`{c}`").alias(c) for c in docs.columns))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents found toxic go."""
    chain = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("text", F.struct(*_columns(docs)).alias("_own")), chain).where("NOT toxic").select("_own.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in the first one only; every document stays."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    own = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(None)
    done = line_dedup.line_dedup(docs.select("doc_id", "text", own.alias("_own")))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}
    return done.select(*(made.get(c, F.col(f"_own.`{c}`").alias(c)) for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    kept = near_dedup.near_dedup(docs).where("kept").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    return named.select(*_columns(docs)).unionByName(docs.where("doc_id IS NULL"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with their place in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("toxicity", toxic), ("line dedup", lines), ("MinHash near-dedup", near), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs


#: Fitted models, similarity joins and tokenizers aren't expressible in SQL.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
