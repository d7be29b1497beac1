"""Evidence of stories kept as counts, to which each round of checks adds what it changed.

The counts of a story are sums over its checks, so a check that changes takes its old row's
ones off and adds its new row's. The table of counts is a log of such rows, dealt to folders
by story: a round appends one row for each story that it changed and reads again only
those stories' rows, never the other checks. ``compacted`` sums the log up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import store
from vigil.config import PENDING, Config
from vigil.functions import fixed
from vigil.operators.threshold import archive_due, base_threshold, effective, vote_counts

COUNTS = ["citation_count", "deleted", "blocked", "hard_deleted", "hard_blocked"]
FOLDERS = 64


def _ones(status: Column, http_code: Column) -> dict[str, Column]:
    gone, refused, no = status == "deleted", status == "blocked", F.lit(False)
    flags = {"citation_count": F.lit(True), "deleted": gone, "blocked": refused, "hard_deleted": gone & http_code.isin(fixed.HARD_CODES), "hard_blocked": refused & (http_code == 403)}
    return {k: F.coalesce(v, no).cast("long") for k, v in flags.items()}


def count_rows(checks: DataFrame) -> DataFrame:
    """story_id and the counts of all its checks (one for a story and url): what a table of counts begins with."""
    return checks.select("story_id", *[c.alias(k) for k, c in _ones(F.col("status"), F.col("http_code")).items()]).groupBy("story_id").agg(*[F.sum(k).alias(k) for k in COUNTS])


def changes(rechecked: DataFrame, known: bool = True) -> DataFrame:
    """story_id and what a round adds to its counts, for stories where that is not nothing.

    rechecked: story_id, status, http_code, and previous_status and previous_code of the
    same check. known: the checks were counted before; else they are new ones.
    """
    new = _ones(F.col("status"), F.col("http_code"))
    old = _ones(F.col("previous_status"), F.col("previous_code")) if known else dict.fromkeys(COUNTS, F.lit(0))
    added = rechecked.select("story_id", *[(new[k] - old[k]).alias(k) for k in COUNTS]).groupBy("story_id").agg(*[F.sum(k).alias(k) for k in COUNTS])
    return added.where(" or ".join(f"{k} <> 0" for k in COUNTS))


class Counts:
    """A table of counts: a log of rows in folders by story, one sub-folder for each round.

    A round that runs again replaces its rows, so it counts once.
    """

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or store.new_path(spark, "counts")

    def _rows(self) -> DataFrame:
        schema = "story_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", round long, folder int"
        return self.spark.read.schema(schema).parquet(self.path)

    def add(self, rows: DataFrame, number: int) -> None:
        """The rows of a round (story_id and the counts); number: its own, from 0."""
        folder = F.pmod(F.xxhash64(F.col("story_id").cast("long")), F.lit(FOLDERS)).cast("int")
        named = rows.select(F.col("story_id").cast("long").alias("story_id"), *COUNTS, F.lit(number).cast("long").alias("round"), folder.alias("folder"))
        gone = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/round={number}")
        gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)
        named.drop("round").repartition("folder").write.partitionBy("folder").parquet(f"{self.path}/round={number}")

    def of(self, ids: DataFrame | None = None) -> DataFrame:
        """The counts of the stories named by the column story_id, or of all; only folders that hold some are read."""
        rows = self._rows()
        if ids is not None:
            asked = ids.select(F.col("story_id").cast("long").alias("story_id")).distinct()
            asked = asked.withColumn("folder", F.pmod(F.xxhash64("story_id"), F.lit(FOLDERS)).cast("int"))
            folders = [r["folder"] for r in asked.select("folder").distinct().collect()]  # FOLDERS at most
            rows = rows.where(F.col("folder").isin(folders)).join(asked, ["story_id", "folder"], "left_semi")
        return rows.groupBy("story_id").agg(*[F.sum(k).alias(k) for k in COUNTS])

    def compacted(self, path: str | None = None) -> Counts:
        """A new table with one round, the sum of all."""
        new = Counts(self.spark, path)
        new.add(self.of(), 0)
        return new


def signals_of(ids: DataFrame, counts: Counts, stories: DataFrame, votes: DataFrame, as_of: Column, cfg: Config = Config()) -> DataFrame:
    """``threshold.story_signals`` of the stories named by story_id alone, from their counts."""
    asked = ids.select(F.col("story_id").alias("__s")).distinct()
    rows = stories.join(asked, stories["id"] == F.col("__s"), "left_semi")
    held = counts.of(ids).withColumnRenamed("story_id", "__c")
    cast = votes.join(asked, votes["story_id"] == F.col("__s"), "left_semi")
    rows = rows.join(held, rows["id"] == F.col("__c"), "left").drop("__c").join(vote_counts(cast).withColumnRenamed("story_id", "__v"), F.col("id") == F.col("__v"), "left").drop("__v")
    base = base_threshold(votes, as_of, cfg).select(F.col("threshold").alias("base_threshold"))
    rows = rows.fillna(0, [*COUNTS, "votes"]).join(F.broadcast(base))  # one row
    tx = F.col("arweave_tx_id")
    level = effective(F.col("base_threshold"), F.col("hard_deleted"), F.col("hard_blocked"))
    archived = F.coalesce(tx.isNotNull() & (tx != "") & (tx != PENDING), F.lit(False))
    return rows.withColumn("__e", level).select(*rows.columns, "__e.threshold", "__e.urgency", archived.alias("archived"))


def triggered(rechecked: DataFrame, counts: Counts, number: int, stories: DataFrame, votes: DataFrame, as_of: Column, cfg: Config = Config()) -> DataFrame:
    """The stories to archive after a round of checks: those in which something is newly gone, with enough votes by
    their new counts, not archived yet. rechecked: as for ``changes``, with newly_gone; read more than once.
    """
    counts.add(changes(rechecked), number)
    gone = rechecked.where("newly_gone and story_id is not null").select("story_id")
    return archive_due(signals_of(gone, counts, stories, votes, as_of, cfg))
