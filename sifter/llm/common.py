"""Helpers shared by the corpus operators: shipping, stored tables, checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.deploy import ship_package
from sifter.functions.broadcasting import shuffled
from sifter.session import scratch_path
from sifter.sources.tables import table

ARROW_BATCH_BYTES = 4 << 20
BROADCAST_BYTES = 64 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound the size of Arrow batches (long texts) once per session."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared checkpoint folder, read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when rows x row_bytes (as a hash table holds them) fits ``limit``; otherwise a shuffle join.

    ``df`` should be a stored table of fixed-width rows: the count is then exact and cheap.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else shuffled(df)


def text_key(text: str = "text"):
    """A 64-bit hash of a text; with the id it names a row even where ids repeat or are null."""
    return F.xxhash64(F.col(text))


def drawn(label: str, columns: list[str], share: float):
    """True for ``share`` of the values of ``columns``, by 63 bits of a hash: exact however small the share is."""
    if share >= 1.0:
        return F.lit(True)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(label), *columns), 1)
    return draw < F.lit(int(share * (1 << 63)))


def blocks_of(items: list, size: int) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i:i + size]


__all__ = ["prepare", "stored", "checked_broadcast", "text_key", "drawn", "blocks_of", "table", "scratch_path"]
