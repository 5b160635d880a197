"""Incremental load of landing season files with Structured Streaming.

New season CSVs dropped into a folder are picked up by the file stream source;
every micro-batch is cleaned (P3) and inserted-if-absent (S5) into the clean
match table by its natural key. ``foreachBatch`` may replay a batch after a
failure; the anti join against the target makes the replay a no-op, so the
sink is effectively exactly-once. Progress lives in the checkpoint location
(a shared folder), so a restarted query resumes where it stopped.

The file source needs one schema per stream: run one stream per header
layout (files whose columns drift go to their own folder / stream).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import clean_matches
from ..operators.star import NATURAL_MATCH_KEY, anti_new_rows
from ..sources.files import SEASON_FROM_PATH


def raw_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def season_file_stream(spark: SparkSession, folder: str, columns: Sequence[str], max_files_per_trigger: int = 100) -> DataFrame:
    """Stream of raw rows from ``folder``, tagged with season and source file."""
    stream = (spark.readStream.schema(raw_schema(columns)).option("header", True)
              .option("maxFilesPerTrigger", max_files_per_trigger).csv(folder))
    path = F.col("_metadata.file_path")
    return stream.select("*", F.regexp_extract(path, SEASON_FROM_PATH, 1).alias("season"), path.alias("source_file"))


def _upsert(target_path: str, key: Sequence[str]):
    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("file_row", F.monotonically_increasing_id())  # position within the micro-batch
        cleaned = clean_matches(batch, key=key, order=("source_file", "file_row")).drop("source_file", "file_row")
        path = spark._jvm.org.apache.hadoop.fs.Path(target_path)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # first batch: no table yet
            cleaned.write.mode("append").parquet(target_path)
            return
        target = spark.read.parquet(target_path)
        # Only the batch's seasons of the table can hold its keys; they are few.
        seasons = [r[0] for r in cleaned.select("season").distinct().collect()]
        known = target.where(F.col("season").isin(seasons))
        anti_new_rows(known, cleaned.select(*target.columns), list(key)).write.mode("append").parquet(target_path)

    return run


def start_incremental_load(spark: SparkSession, folder: str, columns: Sequence[str], target_path: str,
                           checkpoint_location: str, key: Sequence[str] = NATURAL_MATCH_KEY,
                           available_now: bool = True) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what has landed and stops."""
    key = [k for k in key if k != "league"] if "Div" not in columns else list(key)
    stream = season_file_stream(spark, folder, columns)
    if "Div" in columns:
        stream = stream.withColumn("league", F.col("Div"))
    writer = (stream.writeStream.foreachBatch(_upsert(target_path, key))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
