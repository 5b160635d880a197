"""File sources and sinks.

Season CSVs drift: their column sets differ and names differ in case. A
single multi-file ``spark.read.csv`` would bind columns by position, so files
are grouped by header (read in one job) and every group is read in one scan with an all-string
schema; groups are then aligned by name (``unionByName``). The season comes
from the file name, per row (``_metadata.file_path``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.perspective import concat_frames

SEASON_FROM_PATH = r"season[_=]([A-Za-z0-9]+)"
BOM = "﻿"


def normalise_header(names: Sequence[str]) -> list[str]:
    """Strip a byte-order mark (also its latin-1 rendering) and blanks from column names;
    a name that repeats an earlier one but for case gets a number (``AHh``, ``AHH_2``)."""
    out, seen = [], defaultdict(int)
    for n in names:
        n = n.replace(BOM, "").replace("ï»¿", "").strip()
        seen[n.lower()] += 1
        k = seen[n.lower()]
        out.append(n if k == 1 else f"{n}_{k}")
    return out


def _csv(spark: SparkSession, encoding: str):
    return spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """File paths matching a glob, via the Hadoop file system the cluster uses (metadata only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    statuses = fs.globStatus(path) or []
    out = []
    for st in statuses:
        if st.isDirectory():
            for child in fs.listStatus(st.getPath()):
                name = child.getPath().getName()
                if child.isFile() and not name.startswith(("_", ".")):
                    out.append(child.getPath().toString())
        else:
            out.append(st.getPath().toString())
    return sorted(out)


def _first_lines(encoding: str):
    """Map of (path, raw line) to the first line of each file; the rows of one split come together."""
    def run(frames):
        import numpy as np
        import pyarrow as pa

        last = None
        for f in frames:
            # A path repeats on every line of its file: its number in the batch tells where the next file begins.
            path = f.column(0).dictionary_encode()
            code, names = path.indices.to_numpy(), path.dictionary.to_pylist()
            if not len(code):
                continue
            keep = [*([0] if names[code[0]] != last else []), *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist()]
            last = names[code[-1]]
            if keep:
                lines = [f.column(1)[i].as_py().decode(encoding, "replace").rstrip("\r") for i in keep]
                yield pa.RecordBatch.from_arrays([pa.array([names[code[i]] for i in keep]), pa.array(lines, pa.string())], ["path", "line"])

    return run


def read_headers(spark: SparkSession, paths: Sequence[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """(path, line): the first line of every file, by one distributed job over the files' first splits."""
    if not paths:
        return spark.createDataFrame([], "path string, line string")
    # The text source hands on a line's bytes as they are.
    starts = spark.read.text(list(paths)).where(F.col("_metadata.file_block_start") == 0)
    return starts.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line")).mapInArrow(_first_lines(encoding), "path string, line string")


def layouts(headers: DataFrame) -> list[tuple[tuple[str, ...], list[str]]]:
    """(columns, paths) of each distinct header line, grouped by Spark; the driver, which lists the files anyway,
    gets one row a layout. Files without a line have no layout."""
    import csv
    from urllib.parse import unquote

    rows = headers.groupBy("line").agg(F.array_sort(F.collect_set("path")).alias("paths")).orderBy("line").collect()
    return [(tuple(next(csv.reader([r["line"]]), [])), [unquote(p) for p in r["paths"]]) for r in rows if r["line"]]


def read_seasons(spark: SparkSession, paths: Sequence[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """S1 + S2 + U2: read season files, tag rows with the season from the path,
    align drifting headers by name. Rows keep ``source_file`` and a ``file_row``
    position for keep-first de-duplication."""
    frames = []
    for header, files in layouts(read_headers(spark, paths, encoding)):
        clean = normalise_header(header)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in clean])
        df = _csv(spark, encoding).schema(schema).option("enforceSchema", True).csv(files)
        df = df.select("*", F.col("_metadata.file_path").alias("source_file"),
                       F.monotonically_increasing_id().alias("_row"))
        frames.append(df)
    out = concat_frames(frames)
    return out.select(*[c for c in out.columns if c not in ("source_file", "_row")],
                      F.regexp_extract("source_file", SEASON_FROM_PATH, 1).alias("season"),
                      "source_file", F.col("_row").alias("file_row"))


def write_raw_seasons(raw: DataFrame, base: str, columns_by_group: dict[str, list[str]],
                      group_col: str = "header_group") -> list[str]:
    """Write raw season frames as CSV folders named ``season=<code>``; each header
    group writes only its own columns (that is how the files drift). Returns
    one glob per group."""
    paths = []
    for g, cols in columns_by_group.items():
        part = raw.where(F.col(group_col) == g).select(*cols, "season")
        part.write.mode("overwrite").partitionBy("season").option("header", True).csv(f"{base}/{g}")
        paths.append(f"{base}/{g}/season=*")
    return paths


def write_clean(clean: DataFrame, path: str) -> str:
    """S3: persist the clean frame in a folder a season, its rows by league: seasons are few, leagues grow with the data."""
    (clean.hint("rebalance", "season", "league").sortWithinPartitions("season", "league")
     .write.mode("overwrite").partitionBy("season").parquet(path))
    return path


def read_clean(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S3: reload the clean frame (timestamp re-typed); a missing path is an error."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.withColumn("match_datetime", F.col("match_datetime").cast("timestamp_ntz"))


# The columns of a fixture file.
FIXTURE_COLUMNS = ("Match Number", "Round Number", "Date", "Location", "Home Team", "Away Team", "Result")


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Fixture CSV → (match_number, round_number, match_datetime, location,
    home_team, away_team, result); dates ``dd/MM/yyyy HH:mm``, bad → NULL."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in FIXTURE_COLUMNS])
    df = spark.read.option("header", True).schema(schema).csv(path)
    from ..functions.scalars import DAY_FIRST_DATETIME_FORMATS

    ts = F.coalesce(*[F.try_to_timestamp(F.trim("Date"), F.lit(f)).cast("timestamp_ntz") for f in DAY_FIRST_DATETIME_FORMATS])
    return df.select(F.col("Match Number").try_cast("long").alias("match_number"),
                     F.col("Round Number").try_cast("long").alias("round_number"),
                     ts.alias("match_datetime"), F.trim("Location").alias("location"),
                     F.trim("Home Team").alias("home_team"), F.trim("Away Team").alias("away_team"),
                     F.col("Result").alias("result"))


# The fields of a metrics document.
METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("league", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("predictions", T.LongType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("correct_predictions", T.LongType()),
    T.StructField("total_predictions", T.LongType()),
    T.StructField("prediction_distribution", T.StructType([T.StructField(o, T.LongType()) for o in "HDA"])),
    T.StructField("actual_distribution", T.StructType([T.StructField(o, T.LongType()) for o in "HDA"])),
    T.StructField("accuracy_by_type", T.StructType([T.StructField(o, T.DoubleType()) for o in "HDA"])),
    T.StructField("matchweek_stats", T.MapType(T.StringType(), T.StructType(
        [T.StructField("correct", T.LongType()), T.StructField("total", T.LongType())]))),
    T.StructField("test_season", T.StringType()),
    T.StructField("test_matches", T.LongType()),
])


def write_metrics(metrics: DataFrame, path: str) -> str:
    """Nested metrics as JSON lines (one per model, league and season)."""
    metrics.write.mode("overwrite").json(path)
    return path


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics back with an explicit schema; absent numbers default to 0."""
    df = spark.read.schema(METRICS_SCHEMA).json(path)
    return df.select("model", "league", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
                     F.coalesce("predictions", F.lit(0)).alias("predictions"), "model_type",
                     F.coalesce("correct_predictions", F.lit(0)).alias("correct_predictions"),
                     F.coalesce("total_predictions", F.lit(0)).alias("total_predictions"),
                     "prediction_distribution", "actual_distribution", "accuracy_by_type",
                     F.coalesce("matchweek_stats", F.create_map().cast(METRICS_SCHEMA["matchweek_stats"].dataType)).alias("matchweek_stats"),
                     "test_season", F.coalesce("test_matches", F.lit(0)).alias("test_matches"))


def fixture_rows(matches: DataFrame, weeks: DataFrame) -> DataFrame:
    """Fixture-file layout for a set of matches (used to write S8 inputs)."""
    j = matches.join(weeks.select("match_id", "season_position", "matchweek"), "match_id")
    return j.select(F.col("season_position").cast("string").alias("Match Number"),
                    F.col("matchweek").cast("string").alias("Round Number"),
                    F.date_format("match_datetime", "dd/MM/yyyy HH:mm").alias("Date"),
                    F.col("league").alias("Location"), F.col("home_team").alias("Home Team"),
                    F.col("away_team").alias("Away Team"), F.lit(None).cast("string").alias("Result"))

