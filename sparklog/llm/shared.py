"""What several operators of this subpackage need: staging, batching, words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.plans.staging import Scratch, shared_folder

__all__ = ["Scratch", "shared_folder"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that Python code holds in its own form at a time.
CHUNK_BYTES = 4_000_000

#: Bytes of stored input for each shuffle partition of fingerprints.
PARTITION_BYTES = 16_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; for files, their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def measured(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs``, written and reread if the optimizer only guesses its size: where it doesn't come from files, or from a join."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    return docs if plan.collectLeaves().size() == 1 and stored_bytes(docs) < 1 << 50 else scratch.save(docs, "measured")


def fingerprint_partitions(docs: DataFrame, bytes_each: int = PARTITION_BYTES) -> int:
    """How many shuffle partitions keep each within ``bytes_each`` of a ``measured`` input."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(stored_bytes(docs) / bytes_each))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front, so that no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def utf8(text: pa.Array) -> list[bytes]:
    """The rows as bytes; null as empty."""
    if pa.types.is_large_string(text.type):
        text = text.cast(pa.large_binary())
    elif pa.types.is_string(text.type):
        text = text.cast(pa.binary())
    return [x or b"" for x in text.to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a row is never cut."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
