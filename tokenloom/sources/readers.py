"""Readers of corpora, vocabularies and models; choice of the text column."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.text import BYTE_CHAR, from_hex

#: Columns that hold the text in known sources; all others are looked for.
KNOWN_COLUMNS = {"starcoder": "content"}
_USUAL = ("text", "content", "code")


def text_column(schema: T.StructType, wanted: str | None = None, lenient: bool = False) -> str:
    """The text column: the wanted one, a usual name, the first of strings; if lenient, any first column."""
    names = schema.fieldNames()
    if wanted is not None:
        if wanted not in names:
            raise ValueError(f"no column {wanted!r} among {', '.join(names)}")
        return wanted
    for name in _USUAL:
        if name in names:
            return name
    for field in schema.fields:
        if isinstance(field.dataType, (T.StringType, T.VarcharType, T.CharType)):
            return field.name
    if lenient and names:
        return names[0]
    raise ValueError(f"no text column among {', '.join(names)}")


def as_text(df: DataFrame, wanted: str | None = None, lenient: bool = False) -> DataFrame:
    """Only the text column, as a string named text."""
    return df.select(F.col(f"`{text_column(df.schema, wanted, lenient)}`").cast("string").alias("text"))


def parquet_files(path: str) -> list[str]:
    """Sorted Parquet files of a file or a folder and all below it; an error if there are none."""
    root = Path(path)
    if root.is_file():
        if root.suffix != ".parquet":
            raise ValueError(f"{path} is not a Parquet file")
        return [str(root)]
    found = sorted(str(p) for p in root.rglob("*.parquet") if p.is_file())
    if not found:
        raise FileNotFoundError(f"no Parquet files below {path}")
    return found


def source_files(base: str, sources: list[str]) -> dict[str, list[str]]:
    """Sorted Parquet files of each source folder."""
    missing = [s for s in sources if not Path(base, s).is_dir()]
    if missing:
        raise FileNotFoundError(f"no folder for {', '.join(missing)} in {base}")
    return {s: parquet_files(str(Path(base, s))) for s in sources}


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus folder as one text column: source folders with known columns, or everything below."""
    folders = sorted(p for p in Path(path).iterdir() if p.is_dir() and not p.name.startswith((".", "_"))) if Path(path).is_dir() else []
    parts = []
    for folder in folders:
        files = sorted(map(str, folder.rglob("*.parquet")))
        if files:
            df = spark.read.parquet(*files)
            wanted = KNOWN_COLUMNS.get(folder.name)
            parts.append(as_text(df, wanted if wanted in df.columns else None).withColumn("source", F.lit(folder.name)))
    if parts:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    return as_text(spark.read.option("recursiveFileLookup", True).parquet(path)).withColumn("source", F.lit(Path(path).name))


def read_sources(spark: SparkSession, base: str, sources: list[str], columns: dict[str, str] | None = None) -> DataFrame:
    """Source folders with file path; a configured column that is missing is an error."""
    out = None
    for source, files in source_files(base, sources).items():
        df = spark.read.parquet(*files)
        name = text_column(df.schema, (columns or {}).get(source), lenient=True)
        part = df.select(F.col(f"`{name}`").cast("string").alias("text"), F.lit(source).alias("source"), F.col("_metadata.file_path").alias("file"))
        out = part if out is None else out.unionByName(part)
    return out


def first_shards(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Text of the first n shards by name."""
    if n <= 0:
        raise ValueError("the number of shards must be positive")
    return as_text(spark.read.parquet(*parquet_files(path)[:n]), "text")


def read_jsonl(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Texts of a file of JSON lines, the first ``rows`` if given."""
    df = spark.read.schema("text string").json(path)
    return df if rows is None else df.limit(rows)


def read_hex_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Tokens written as one line of hex digits each."""
    return spark.read.text(path).where("value <> ''").select(from_hex(F.trim("value")).alias("token"))


def raw_vocabularies(spark: SparkSession, path: str) -> DataFrame:
    """Fractional vocabularies of all sizes; vocab_size is a partition column."""
    return spark.read.parquet(path)


def tokenizer_vocabulary(path: str) -> dict[str, int]:
    """Tokens and ids of a tokenizer.json: a mapping (BPE) or a list of pairs (Unigram)."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return dict(vocab) if isinstance(vocab, dict) else {t: i for i, (t, *_) in enumerate(vocab)}


def read_model(path: str) -> dict:
    """A model text file: header, pattern and counted sections; tokens come back byte-level."""
    with open(path, encoding="utf-8") as f:
        lines = iter(f.read().split("\n"))
    header = next(lines)
    if not re.fullmatch(r"\w+ v1", header):
        raise ValueError(f"{path} has the unknown header {header!r}")
    level = lambda h: "".join(BYTE_CHAR[b] for b in bytes.fromhex(h))
    out: dict = {"kind": header.split()[0], "pattern": json.loads(next(lines))}
    for section in ("vocab", "specials", "merges", "deletions"):
        name, n = next(lines).split()
        if name != section:
            raise ValueError(f"{path} has {name} instead of {section}")
        rows = [next(lines).split(" ") for _ in range(int(n))]
        if section == "specials":
            out[section] = {json.loads(" ".join(r[:-1])): int(r[-1]) for r in rows}
        elif section == "vocab":
            out[section] = {level(r[0]): int(r[1]) for r in rows}
        elif section == "merges":
            out[section] = {int(r[2]): (level(r[0]), level(r[1])) for r in rows}
        else:
            out[section] = {int(r[1]): level(r[0]) for r in rows}
    return out


_SUBJECTS = ["tokenization", "language modeling", "information retrieval", "machine translation", "speech recognition", "document ranking", "data compression"]
_SAMPLES = ["plain words, don't and 42.", "Zürich: größere Wörter.", "un café déjà vu.", "el pingüino rápidamente.", "日本語の文章123。", "Ελληνικά δείγμα."]


def tiny_corpus(spark: SparkSession, rows: int = 256) -> DataFrame:
    """A deterministic corpus with digits, code, tabs, repeated spaces and several scripts."""
    at = lambda names, k: F.get(F.array(*map(F.lit, names)), (F.col("id") % k).cast("int"))
    n = lambda k: (F.col("id") % k).cast("string")
    text = F.concat(
        F.lit("Row "), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(" of run_"), n(37), F.lit(" is about "), at(_SUBJECTS, 7), F.lit(".\nScore "), ((F.col("id") * 17) % 101).cast("string"), F.lit("."), n(10),
        F.lit("; shard-"), n(5), F.lit(" = f(x_"), n(23), F.lit(") \t  "), at(_SAMPLES, 6), F.lit("\nEnd "), n(11), F.lit("\t!"),
    )
    return spark.range(rows).select(text.alias("text"), F.col("id").alias("document_id"))
