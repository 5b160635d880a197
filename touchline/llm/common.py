"""Helpers shared by the training-data operators.

Texts travel as UTF-8 bytes.  Intermediate tables are written as Parquet into
the shared folder the session names in ``spark.checkpoint.dir``, so a lost
executor never costs more than the stage that is running.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Word separators of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body): the two columns an operator needs, the text as UTF-8 bytes (null: empty)."""
    return df.select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("body"))


def text_hash(text_col: str | Column = "text") -> Column:
    """64-bit hash of a row's text (null: of the empty text); with the id it tells rows apart."""
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.xxhash64(F.coalesce(text.cast("string").cast("binary"), F.lit(b"")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more."""
    path = getattr(df, "_written_to", None)
    if path:
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def parallelism(spark: SparkSession) -> int:
    """Partitions for a keyed shuffle: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def split_hot_blocks(rows: DataFrame, keys: list[str], salt: str, most: int) -> DataFrame:
    """``rows`` with ``sub``, which cuts every group of ``keys`` that has over twice ``most`` rows into parts of about ``most``.

    Hashed groups hold about ``most`` rows each unless many rows are alike in all that is hashed; those are told apart
    by ``salt``, a number of the written row.  Other groups keep ``sub`` 0."""
    n = F.col("count")
    parts = rows.groupBy(*keys).count().select(*keys, F.when(n > 2 * most, F.ceil(n / most)).otherwise(F.lit(1)).cast("int").alias("_parts"))
    return rows.join(parts, keys).withColumn("sub", F.pmod(F.xxhash64(salt), F.col("_parts")).cast("int")).drop("_parts")


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def crc_fold_py(doc_id, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def lower_ascii(body: bytes) -> bytes:
    """Lower-case A-Z only (``bytes.lower`` leaves every other byte alone)."""
    return body.lower()


def batches(frames: Iterator, *names: str) -> Iterator[tuple[list, ...]]:
    """Python lists of the named columns of each non-empty Arrow batch."""
    for b in frames:
        if b.num_rows:
            yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising mix (multiply-xorshift), vectorised."""
    with np.errstate(over="ignore"):
        y = x >> np.uint64(30)
        y ^= x
        y *= np.uint64(0xBF58476D1CE4E5B9)
        y ^= y >> np.uint64(27)
        y *= np.uint64(0x94D049BB133111EB)
        y ^= y >> np.uint64(31)
        return y
