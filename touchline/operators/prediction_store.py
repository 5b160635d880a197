"""Stored predictions and top scores, replaced by (match, model).

Both tables are partitioned by model and by a hash bucket of the match, so an
upsert reads and rewrites only the partitions its own rows fall into (dynamic
partition overwrite): the merge of one model's new run never touches another
model. Probabilities are DECIMAL(5,4), as the sink declares them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

PROBABILITY = "decimal(5,4)"
SUMMARY = f"match_id long, model_version string, prob_home_win {PROBABILITY}, prob_draw {PROBABILITY}, prob_away_win {PROBABILITY}, model_name string, bucket int"
TOP_SCORES = f"match_id long, rank_order int, home_goals int, away_goals int, probability {PROBABILITY}, model_name string, bucket int"
KEY = ("match_id", "model_name")


class PredictionStore:
    """Tables ``predictions_summary`` and ``predicted_top_scores`` under ``root``; ``buckets`` partitions a model."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 8) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _read(self, table: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def summary(self) -> DataFrame:
        return self._read("predictions_summary", SUMMARY).drop("bucket")

    def top_scores(self) -> DataFrame:
        return self._read("predicted_top_scores", TOP_SCORES).drop("bucket")

    def _upsert(self, table: str, schema: str, new: DataFrame, probabilities: Sequence[str], unique: Sequence[str]) -> None:
        target = self.spark.createDataFrame([], schema).schema
        marked = new.withColumn("bucket", F.pmod(F.xxhash64("match_id"), F.lit(self.buckets)).cast("int"))
        # Written first: the checks below read values, not the model that makes them.
        fresh = written(marked.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target]), table)
        bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | ~F.col(c).between(0, 1) for c in probabilities])
        if fresh.where(bad).limit(1).count():
            raise ValueError(f"{table}: probabilities must lie between 0 and 1")
        if fresh.groupBy(*unique).count().where("count > 1").limit(1).count():
            raise ValueError(f"{table}: one row for each {', '.join(unique)}")
        # At most models x buckets of this run: the partitions to read again.
        touched = fresh.select("model_name", "bucket").distinct().collect()
        if not touched:
            return
        buckets: dict[str, list[int]] = {}
        for r in touched:
            buckets.setdefault(r["model_name"], []).append(r["bucket"])
        hit = F.lit(False)
        for model, some in buckets.items():
            hit = hit | ((F.col("model_name") == model) & F.col("bucket").isin(some))
        kept = self._read(table, schema).where(hit).join(fresh.select(*KEY).distinct(), list(KEY), "left_anti")
        # Written before the overwrite, which replaces what it is merged from.
        merged = written(kept.select(fresh.columns).unionByName(fresh), table)
        (merged.repartition("model_name", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("model_name", "bucket").parquet(f"{self.root}/{table}"))

    def upsert_summary(self, predictions: DataFrame, version: str) -> None:
        """Replace or add (match_id, model_name, p_home, p_draw, p_away); a repeated key raises."""
        self._upsert("predictions_summary", SUMMARY, predictions.select(
            *KEY, F.lit(version).alias("model_version"), F.col("p_home").alias("prob_home_win"), F.col("p_draw").alias("prob_draw"),
            F.col("p_away").alias("prob_away_win")), ("prob_home_win", "prob_draw", "prob_away_win"), KEY)

    def upsert_top_scores(self, tops: DataFrame) -> None:
        """Replace all ranks of each (match_id, model_name) by (rank_order, home_goals, away_goals, probability)."""
        self._upsert("predicted_top_scores", TOP_SCORES, tops, ("probability",), (*KEY, "rank_order"))
