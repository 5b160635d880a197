"""Star tables that batches are added to, each batch visible whole or not at all.

``root/data/<table>/<batch>/`` holds what a batch added to a table,
``root/commits/<batch>`` is written last. Readers read the folders of the
committed batches only, so a load that dies leaves nothing visible: its staged
folders are overwritten when the batch is loaded again. Every table takes a
batch's rows as INSERT IGNORE does: rows whose declared key is stored stay out,
of several new rows with one key the first by source id goes in. Rows that
cannot be loaded go to the batch's ``quarantine`` with table and reason.

One writer at a time; any number of readers. All joins are on declared keys;
the stored side is read with its key columns only.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, season_name
from ..session import written
from .chunked import global_row_number
from .form import dedupe_keep_first

#: Declared keys of the stored tables (fixed values of the data model).
KEYS = {"leagues": ["name"], "seasons": ["league_id", "name"], "teams": ["name"],
        "matches": ["season_id", "date", "home_team_id", "away_team_id"], "match_stats": ["match_id"],
        "match_market_odds": ["match_id"], "team_ratings": ["team_id", "season_id", "date"]}
ODDS = tuple(f"{book}_{side}_odds" for book in ("b365", "market_avg") for side in ("home_win", "draw", "away_win"))
SCHEMAS = {
    "leagues": "id long, name string", "seasons": "id long, league_id long, name string", "teams": "id long, name string",
    "matches": "id long, season_id long, date timestamp_ntz, home_team_id long, away_team_id long, home_team_goals int, away_team_goals int, result string",
    "match_market_odds": "match_id long, " + ", ".join(f"{c} decimal(8,3)" for c in ODDS),
    "team_ratings": "team_id long, season_id long, date timestamp_ntz, rating decimal(7,2)",
    "quarantine": "table string, reason string, source_id long, detail string"}


class StarStore:
    """The stored star under ``root``; ``stats`` are the statistics columns of ``match_stats``."""

    def __init__(self, spark: SparkSession, root: str, stats: Sequence[str] = ("home_shots", "away_shots", "home_corners", "away_corners")) -> None:
        self.spark, self.root, self.stats = spark, root.rstrip("/"), list(stats)
        self.schemas = SCHEMAS | {"match_stats": "match_id long, " + ", ".join(f"{c} int" for c in self.stats)}

    def _fs(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def committed(self) -> list[str]:
        """Ids of the committed batches, in order of their commits."""
        fs, path = self._fs(f"{self.root}/commits")
        if not fs.exists(path):
            return []
        found = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(path)]
        names = [n for _, n in sorted(found) if not n.startswith("_")]
        return sorted(names, key=lambda n: int(n.split("-", 1)[0]))

    def batches(self) -> list[str]:
        """The callers' batch ids, in order of their commits."""
        return [n.split("-", 1)[1] for n in self.committed()]

    def table(self, name: str, upto: str | None = None) -> DataFrame:
        """The rows of a table that all committed batches added, or those up to batch ``upto``."""
        ids = self.batches()
        if upto is not None:
            ids = ids[:ids.index(upto) + 1]
        if not ids:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*[f"{self.root}/data/{name}/{i}" for i in ids])

    def tables(self, upto: str | None = None) -> dict[str, DataFrame]:
        return {name: self.table(name, upto) for name in KEYS}

    def _stage(self, batch: str, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/data/{name}/{batch}"
        schema = self.spark.createDataFrame([], self.schemas[name]).schema
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _commit(self, batch: str) -> None:
        fs, _ = self._fs(self.root)
        nth = len(self.committed())
        # The order of commits is part of the name; a rename makes it appear whole.
        _, temporary = self._fs(f"{self.root}/staged-{batch}")
        _, final = self._fs(f"{self.root}/commits/{nth:09d}-{batch}")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps({"batch": batch, "tables": list(KEYS)}).encode()))
        out.close()
        fs.mkdirs(final.getParent())
        if not fs.rename(temporary, final):
            raise RuntimeError(f"batch {batch} could not be committed")

    def _dimension(self, batch: str, name: str, rows: DataFrame) -> DataFrame:
        """Stored and new rows of a dimension; new keys are numbered after the stored ones."""
        stored, key = self.table(name), KEYS[name]
        fresh = rows.select(*key).distinct().join(stored.select(*key), key, "left_anti")
        highest = stored.agg(F.max("id")).first()[0] or 0
        return stored.unionByName(self._stage(batch, name, global_row_number(fresh, key, "id", highest)))

    def _fact(self, batch: str, name: str, rows: DataFrame, order: Sequence[str]) -> DataFrame:
        """Stored and new rows of a fact table: the first of each key that is not stored."""
        stored, key = self.table(name), KEYS[name]
        first = dedupe_keep_first(rows, key, order)
        return stored.unionByName(self._stage(batch, name, first.join(stored.select(*key), key, "left_anti")))

    def load(self, batch: str, clean: DataFrame, odds: DataFrame | None = None, ratings: DataFrame | None = None) -> bool:
        """Add one batch: clean matches (``match_id``, league, season, …), raw odds and Elo rows by ``match_id``.
        A batch already committed is left as it is (False)."""
        if batch in self.batches():
            return False
        clean = clean.withColumns({c: clean_text(c) for c in ("home_team", "away_team", "league", "season")})
        blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
        goals = [F.col(c) for c in ("home_goals", "away_goals")]
        reason = (F.when(blank("league") | blank("season"), "unknown_season").when(blank("home_team") | blank("away_team"), "unknown_team")
                  .when(F.col("home_team") == F.col("away_team"), "same_team").when(F.col("match_datetime").isNull(), "bad_date")
                  .when(goals[0].isNull() | goals[1].isNull(), "missing_goals").when((goals[0] < 0) | (goals[1] < 0), "negative_goals")
                  .when(~F.coalesce(F.col("result").isin("H", "D", "A"), F.lit(False)), "bad_result"))
        # Written once, like the keyed rows below: dimensions, facts and rejects read them again.
        judged = written(clean.withColumn("_reason", reason), "star-judged")
        good = judged.where("_reason IS NULL").withColumn("season", season_name("season"))
        rejects = [judged.where("_reason IS NOT NULL").select(F.lit("matches").alias("table"), F.col("_reason").alias("reason"), F.col("match_id").alias("source_id"),
                                                              F.to_json(F.struct("league", "season", "match_datetime", "home_team", "away_team")).alias("detail"))]

        leagues = self._dimension(batch, "leagues", good.select(F.col("league").alias("name")))
        in_league = good.join(leagues.select(F.col("id").alias("league_id"), F.col("name").alias("league")), "league")
        seasons = self._dimension(batch, "seasons", in_league.select("league_id", F.col("season").alias("name")))
        teams = self._dimension(batch, "teams", good.select(F.explode(F.array("home_team", "away_team")).alias("name")))
        side = lambda s: teams.select(F.col("id").alias(f"{s}_team_id"), F.col("name").alias(f"{s}_team"))
        keyed = written(in_league.join(seasons.select(F.col("id").alias("season_id"), "league_id", F.col("name").alias("season")), ["league_id", "season"])
                 .join(side("home"), "home_team").join(side("away"), "away_team").withColumnRenamed("match_datetime", "date").drop("_reason"), "star-keyed")
        matches = self._fact(batch, "matches", keyed.select(F.col("match_id").alias("id"), *KEYS["matches"], F.col("home_goals").alias("home_team_goals"),
                                                           F.col("away_goals").alias("away_team_goals"), "result"), ["id"])
        # Source rows with the id their match is stored under: a repeated match keeps its first id.
        known = written(keyed.withColumnRenamed("match_id", "source_id").join(matches.select(F.col("id").alias("match_id"), *KEYS["matches"]), KEYS["matches"]), "star-known")
        ids = known.select("source_id", "match_id", "season_id", "date", "home_team_id", "away_team_id")
        self._fact(batch, "match_stats", known.select("match_id", "source_id", *[c if c in known.columns else F.lit(None).cast("int").alias(c) for c in self.stats]), ["source_id"])

        def found(rows: DataFrame, table: str) -> DataFrame:
            renamed = rows.withColumnRenamed("match_id", "source_id")
            rejects.append(renamed.join(ids.select("source_id"), "source_id", "left_anti").select(
                F.lit(table).alias("table"), F.lit("no_match").alias("reason"), "source_id", F.lit(None).cast("string").alias("detail")))
            return renamed.join(ids, "source_id")

        for table, rows in (("match_market_odds", odds), ("team_ratings", ratings)):
            if rows is None:
                self._stage(batch, table, self.spark.createDataFrame([], self.schemas[table]))
            elif table == "match_market_odds":
                x = found(rows, table)
                self._fact(batch, table, x.select("match_id", "source_id", *[c if c in x.columns else F.lit(None).cast("decimal(8,3)").alias(c) for c in ODDS]), ["source_id"])
            else:
                sides = F.explode(F.array(*[F.struct(F.col(f"{s}_team_id").alias("team_id"), F.round(F.col(f"elo_{s}_pre"), 2).alias("rating")) for s in ("home", "away")])).alias("v")
                self._fact(batch, table, found(rows, table).select("match_id", "season_id", "date", sides).select("match_id", "season_id", "date", "v.*").where("rating IS NOT NULL"), ["match_id"])
        quarantine = rejects[0]
        for r in rejects[1:]:
            quarantine = quarantine.unionByName(r)
        self._stage(batch, "quarantine", quarantine)
        self._commit(batch)
        return True
