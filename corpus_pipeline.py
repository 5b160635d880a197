"""The corpus pipeline: quality, line runs, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and hands what it reads back to
the next stage.  All but the last return the columns of ``documents``.  A row is
known by its id and its text's hash, so rows that share an id, or have none,
are kept or dropped each for its own text.  Empty ``documents`` give no rows and
an empty ``benchmark`` or ``labels`` drops none.  Columns of any name may stand beside those of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontaminate, line_dedup, packing, quality, simhash
from touchline.llm.common import free_name, materialize, text_hash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text the rule ensemble does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = (quality.score_quality(docs, labels, by_text=True).where("predicted = 0")
           .select(F.col("doc_id").alias("rejected"), F.col("text_hash").alias("rejected_hash")).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["rejected"]) & (text_hash(docs["text"]) == bad["rejected_hash"]), "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated line runs and of any run of 50 or more words."""
    done = line_dedup.dedup_lines(docs, words=line_dedup.RUN)
    n_chars = F.when(F.col("n_units_cut") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n_chars).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: the first by id (null last) and text hash."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), text_hash("text").alias("text_hash"))
    same = (F.col("doc_id.id").eqNullSafe(F.col("component_id.id")) & (F.col("doc_id.text_hash") == F.col("component_id.text_hash")))
    rows = (simhash.near_duplicates(docs.select(row.alias("row"), "text"), words=3, max_bits=3, id_col="row").groupBy("doc_id")
            .agg(F.count("*").alias("rows"), F.max(~same).alias("copy")))
    listed = materialize(rows.where("rows > 1 or copy").select(
        F.col("doc_id.id").alias("listed_id"), F.col("doc_id.text_hash").alias("listed_hash"), "copy"), "pipeline-copies")

    def meets(listed: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(listed["listed_id"]) & (text_hash(docs["text"]) == listed["listed_hash"])

    once = docs.join(listed, meets(listed), "left_anti")
    # Rows alike in id and text, of a text that stays: one of them.
    again = listed.where("not copy")
    hashed = free_name(docs, "text_hash")
    repeated = docs.join(again, meets(again), "left_semi").withColumn(hashed, text_hash("text"))
    return once.unionByName(repeated.dropDuplicates(["doc_id", hashed]).drop(hashed))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document that is left, in bins."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("simhash", near_copy_stage),
          ("decontaminate", leak_stage), ("packing", packing_stage)]

#: No stage but the last could be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
