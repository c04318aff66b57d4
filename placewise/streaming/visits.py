"""Visits and contact attempts as they arrive: checks, de-duplication, scoring, refresh."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise import config
from placewise.functions.text import remark_correction
from placewise.operators import compliance, integrity, lookup, places, reliability, trajectories
from placewise.session import settled

MAX_RETRIES = 5


def valid_visit() -> Column:
    """Ranges a submitted visit must keep (projected metres)."""
    return (
        F.col("account_id").isNotNull()
        & F.col("agent_id").isNotNull()
        & F.col("checkin_ts").isNotNull()
        & F.col("checkin_x").isNotNull()
        & F.col("checkin_y").isNotNull()
        & (F.col("gps_accuracy_m").isNull() | (F.col("gps_accuracy_m") >= 0))
        & (F.col("dwell_s").isNull() | (F.col("dwell_s") >= 0))
    )


def check_visits(visits: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds ``rejected``: null for accepted visits, else the reason; and the correction phrase of the remark."""
    known = accounts.select("account_id", F.lit(True).alias("_known")).distinct()
    out = visits.join(known, "account_id", "left")
    reason = F.when(~valid_visit(), "invalid_value").when(F.col("_known").isNull(), "unknown_account")
    if "remark" in visits.columns:
        out = out.withColumn("correction", remark_correction("remark"))
    return out.withColumn("rejected", reason).drop("_known")


def drop_repeats(visits: DataFrame, delay: str = "1 day") -> DataFrame:
    """Retried submissions of one visit (account, agent, time) pass once within the watermark."""
    timed = visits.withColumn("event_time", F.col("checkin_ts").cast("timestamp")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["account_id", "agent_id", "checkin_ts"]).drop("event_time")


def route_failures(queue: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Adds ``route``: dead_letter after the last retry, else retry, or synced."""
    return queue.withColumn(
        "route",
        F.when(F.col("status") == "synced", "synced").when(F.col("retries") >= max_retries, "dead_letter").otherwise("pending"),
    )


def queue_statistics(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("items"))


def daily_productivity(visits: DataFrame, delay: str = "1 day") -> DataFrame:
    """Visits, productive and untraceable visits per agent and event-time day; rows later than the watermark are dropped."""
    timed = visits.withColumn("event_time", F.col("checkin_ts").cast("timestamp")).withWatermark("event_time", delay)
    counted = timed.groupBy(F.window("event_time", "1 day"), "agent_id").agg(
        F.count(F.lit(1)).alias("visits"),
        F.count_if(F.col("outcome").isin(*config.CANONICAL_SUCCESS)).alias("productive"),
        F.count_if(F.col("outcome") == "ADDRESS_NOT_TRACEABLE").alias("not_traceable"),
    )
    return counted.select("agent_id", F.to_date("window.start").alias("day"), "visits", "productive", "not_traceable")


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived into a Parquet table and stop."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    )
    query.awaitTermination()


@dataclass
class ArrivalRefresh:
    """What happens to each micro-batch of accepted visits (canonical outcomes).

    History and results are Parquet folders with one ``batch=<id>`` partition per
    micro-batch. A replayed batch overwrites its own partition and reads only
    earlier ones, so a restart repeats a batch without counting it twice. ``points``
    (visit_id, seq, x, y, offset_s) are the GPS tracks that have arrived; without them a
    visit's track counts as missing.
    """

    spark: SparkSession
    root: str
    points: DataFrame | None = None

    def _tracks(self, visits: DataFrame) -> DataFrame:
        if self.points is None:
            return self.spark.createDataFrame([], TRACKS)
        own = self.points.join(visits.select("visit_id").distinct(), "visit_id", "left_semi")
        return settled(trajectories.summarise(own, "projected_xy"))

    def _earlier(self, name: str, batch_id: int) -> DataFrame | None:
        path = f"{self.root}/{name}"
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.parquet(path).filter(F.col("batch") < batch_id).drop("batch")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            earlier = self._earlier("visits", batch_id)
            # Only accounts and agents that this batch touches are read back.
            seen = batch if earlier is None else earlier.select(*batch.columns).unionByName(batch)
            of_accounts = seen.join(batch.select("account_id").distinct(), "account_id", "left_semi")
            of_agents = seen.join(batch.select("agent_id").distinct(), "agent_id", "left_semi")
            history = lookup.newest_visits(of_accounts, "account_id")
            # The agents' visits include the batch itself: its tracks are summed up once for both scores.
            tracks = self._tracks(of_agents)
            trust = reliability.score(batch, tracks, history, "projected_xy").select("visit_id", "reliability")
            honest = integrity.detect(of_agents, tracks).select("visit_id", F.col("integrity").alias("integrity_score"), "risk_level")
            scored = batch.join(trust, "visit_id").join(honest, "visit_id")
            self._write(scored, "scores", batch_id)
            hits = of_accounts.filter(F.col("outcome").isin(*config.CANONICAL_SUCCESS)).select(
                "account_id", F.col("visit_id").alias("event_id"), F.col("checkin_ts").alias("ts"), F.col("checkin_x").alias("x"),
                F.col("checkin_y").alias("y"), F.lit(0.9).alias("confidence"), F.col("gps_accuracy_m").alias("radius_m"),
                F.lit("visit_confirmed").alias("source"),
            )
            self._write(places.merge_locations(hits), "locations", batch_id)
            self._grow_clusters(batch, batch_id)
            self._write(batch, "visits", batch_id)
        finally:
            batch.unpersist()

    def _grow_clusters(self, batch: DataFrame, batch_id: int) -> None:
        """Successful visits join a cluster within 100 m or found one; each batch writes the next snapshot."""
        previous = {}
        for name, schema in (("clusters", CLUSTERS), ("members", "cluster_id string, account_id long")):
            empty = self.spark.createDataFrame([], schema)
            if batch_id == 0:
                previous[name] = empty
            else:
                previous[name] = self.spark.read.parquet(f"{self.root}/{name}/batch={batch_id - 1}")
        hits = batch.filter(F.col("outcome").isin(*config.CANONICAL_SUCCESS))
        members, clusters = places.assign_clusters(hits, previous["clusters"], previous["members"], "checkin_x", "checkin_y", 100.0)
        self._write(members, "members", batch_id)
        self._write(clusters, "clusters", batch_id)

    def clusters(self) -> DataFrame:
        """The newest cluster snapshot."""
        rows = self.spark.read.parquet(f"{self.root}/clusters")
        return rows.filter(F.col("batch") == rows.agg(F.max("batch").alias("b")).scalar()).drop("batch")

    def latest_locations(self) -> DataFrame:
        """The newest merged location of every account over all batches."""
        rows = self.spark.read.parquet(f"{self.root}/locations")
        columns = [c for c in rows.columns if c != "batch"]
        return rows.groupBy("account_id").agg(F.max_by(F.struct(*[c for c in columns if c != "account_id"]), "batch").alias("_l")).select(
            "account_id", "_l.*"
        )


CLUSTERS = "cluster_id string, latitude double, longitude double, visit_count long, confidence double"
TRACKS = (
    "visit_id long, n_points long, length_m double, straight_m double, efficiency double, mean_speed_ms double, max_speed_ms double, "
    "stdev_speed_ms double, stationary_s double, gps_jumps long, span_s double, start_a double, start_b double, end_a double, end_b double"
)


def run_batches(stream: DataFrame, handler, checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
