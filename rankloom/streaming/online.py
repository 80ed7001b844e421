"""Online statistics: outcomes arrive as a stream, pair statistics are kept, and the selected arms follow.

The state of a run is its pair sums and its last round, kept by the engine's stateful aggregation, so it survives lost
executors and restarts. Arms are chosen anew each micro-batch, not each round: feedback is that much delayed.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import policy
from ..scratch import shared_dir

OUTCOME_DDL = "run_id string, round int, winner string, loser string, credit double"


def outcomes_from(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes as a stream of Parquet files."""
    return spark.readStream.schema(OUTCOME_DDL).parquet(folder)


def pair_statistics(outcomes: DataFrame) -> DataFrame:
    """(run_id, i, j, w, n, t): streaming form of the cumulative pair statistics."""
    win = F.struct(F.col("winner").alias("i"), F.col("loser").alias("j"), F.col("credit").alias("w"))
    loss = F.struct(F.col("loser").alias("i"), F.col("winner").alias("j"), F.lit(0.0).alias("w"))
    sides = outcomes.select("run_id", "round", F.explode(F.array(win, loss)).alias("s"))
    return sides.groupBy("run_id", F.col("s.i").alias("i"), F.col("s.j").alias("j")).agg(F.sum("s.w").alias("w"), F.count(F.lit(1)).alias("n"), F.max("round").alias("t"))


def windowed_wins(outcomes: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """(window, winner, wins) of outcomes with event times; rows later than ``late`` are left out."""
    stamped = outcomes.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return stamped.groupBy(F.window("__t", width), "winner").agg(F.count(F.lit(1)).alias("wins"))


def replay(outcomes: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream of outcomes to its present end and returns the pair statistics (run_id, i, j, w, n, t).

    Every micro-batch writes the statistics that it changed, with its number, beside the checkpoint; the latest row of
    a pair holds. A batch that is run again after a failure overwrites its own files.
    """
    folder = f"{checkpoint.rstrip('/')}/{name}-statistics"

    def store(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/part={batch}")

    query = pair_statistics(outcomes).writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = outcomes.sparkSession.read.schema("run_id string, i string, j string, w double, n long, t int, batch long").option("recursiveFileLookup", True).parquet(folder)
    return rows.groupBy("run_id", "i", "j").agg(*[F.max_by(c, "batch").alias(c) for c in ("w", "n", "t")])


class Progress(StreamingQueryListener):
    """Collects what one running query tells of each of its batches: the observed metrics of a name, with batch and rows."""

    def __init__(self, metrics: str):
        self.metrics, self.rows, self.run, self.ended = metrics, [], None, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802 - the names are the engine's
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        told = event.progress.observedMetrics.get(self.metrics)
        if told is not None and event.progress.numInputRows > 0:
            self.rows.append((str(event.progress.runId), event.progress.batchId, event.progress.numInputRows, told.asDict()))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) == self.run:
            self.ended.set()


#: Intervals of rounds that one micro-batch holds, and partitions of the state of a stream, which is a few pairs of arms.
SLOTS, STATE_PARTITIONS = 64, 4


def progress(outcomes: DataFrame, every: int = 100, wait: float = 60.0) -> DataFrame:
    """(batch, first_round, last_round, outcomes, credit): what a listener saw while outcomes (round, winner, loser, credit)
    went through the stateful statistics as a stream, a row for every ``every`` rounds that have any.

    Outcomes are written as one file for SLOTS such intervals; files are taken one at a time, in no certain order. The metrics
    are counted by the tasks of the batch itself, each interval's in a slot of its own, and come to the driver as one row a
    batch: an interval doesn't pay for a micro-batch.
    """
    spark = outcomes.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    interval = F.floor((F.col("round") - 1) / every)
    rows = outcomes.select(F.lit("run").alias("run_id"), F.col("round").cast("int").alias("round"), "winner", "loser", "credit").withColumn("slot", F.pmod(interval, F.lit(SLOTS)).cast("int")).withColumn("part", F.floor(interval / SLOTS))
    rows.repartition("part").write.partitionBy("part").parquet(f"{folder}/outcomes")
    source = spark.readStream.schema(OUTCOME_DDL + ", slot int, part long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/outcomes")
    own = lambda k, c: F.when(F.col("slot") == k, F.col(c))
    metrics = [m for k in range(SLOTS) for m in (F.min(own(k, "round")).alias(f"first_{k}"), F.max(own(k, "round")).alias(f"last_{k}"), F.count(own(k, "round")).alias(f"outcomes_{k}"), F.sum(own(k, "credit")).alias(f"credit_{k}"))]
    seen = source.observe("progress", *metrics)
    listener = Progress("progress")
    spark.streams.addListener(listener)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(min(int(partitions), STATE_PARTITIONS)))
        query = pair_statistics(seen).writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        listener.run = str(query.runId)
        query.awaitTermination()
        listener.ended.wait(wait)  # events come after the fact, in order, the end last
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.streams.removeListener(listener)
    batches = [(batch, m) for run, batch, _, m in listener.rows if run == listener.run]
    told = [(batch, m[f"first_{k}"], m[f"last_{k}"], m[f"outcomes_{k}"], m[f"credit_{k}"]) for batch, m in batches for k in range(SLOTS) if m[f"outcomes_{k}"]]
    return spark.createDataFrame(told, "batch long, first_round int, last_round int, outcomes long, credit double")


def selected_arms(stats: DataFrame, arms: DataFrame, run_id: str, n_min: int = 500, alpha: float = 0.51, beta: float = 1.0) -> DataFrame:
    """(ord, arm) that a run plays next, from its statistics so far."""
    own = stats.where(F.col("run_id") == run_id)
    t = own.agg(F.max("t")).first()[0] or 0
    cells = policy.grid(arms, own.select("i", "j", "w", "n"))
    return policy.dueling_selection(policy.set_membership(cells, arms, t, n_min, alpha, beta), t, n_min)
