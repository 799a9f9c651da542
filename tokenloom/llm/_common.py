"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tokenloom.session import shared_dir

#: Text handled at a time inside a Python worker; bounds its memory, never what is processed.
BLOCK_BYTES = 4 << 20


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def release() -> None:
    """Delete the intermediate tables written so far; runs by itself when the driver ends."""
    while _written:
        spark, path = _written.pop()
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives empty bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        lengths = np.diff(np.frombuffer(sizes.buffers()[1], dtype=np.int32)[sizes.offset : sizes.offset + len(sizes) + 1].astype(np.int64))
        at, total = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if total and total + n > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        yield batch.slice(at)


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets everything when it has grown to ``most`` words."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words)), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads each 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plus(df: DataFrame, fields: str) -> T.StructType:
    """The schema of ``df`` with more fields behind."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])


def without(df: DataFrame, fields: str) -> DataFrame:
    """``df`` without columns that bear the name of one of ``fields``, which a result column replaces."""
    names = {f.name.lower() for f in T.StructType.fromDDL(fields).fields}
    return df.drop(*(c for c in df.columns if c.lower() in names))
