"""Predictions of the accounts that arriving visits touch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise import config
from placewise.operators import places
from placewise.plans import geocode
from placewise.session import settled


@dataclass
class PredictionRefresh:
    """Each micro-batch of visits predicts the accounts in it again, from all their visits so far, and merges their locations.

    ``inputs`` holds everything but the visits; ``score`` gives visits (raw history of the touched
    accounts and of the agents in the batch) the columns that ``GeocodeInputs.visits`` names. What the
    addresses say is read once. History and results are Parquet folders with one partition for each
    micro-batch: a replayed batch overwrites its own partition and reads only earlier ones.
    """

    spark: SparkSession
    root: str
    inputs: geocode.GeocodeInputs
    score: Callable[[DataFrame], DataFrame]
    described: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        self.described = geocode.described_accounts(self.inputs.accounts)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = settled(batch)
        earlier = self.spark.read.schema(batch.withColumn("batch", F.lit(0)).schema).parquet(f"{self.root}/visits").filter(F.col("batch") < batch_id).drop("batch") if batch_id else None
        batch.write.mode("overwrite").parquet(f"{self.root}/visits/batch={batch_id}")
        touched, agents = (settled(batch.select(c).distinct()) for c in ("account_id", "agent_id"))
        seen = batch if earlier is None else batch.unionByName(
            earlier.join(touched.withColumn("_t", F.lit(True)), "account_id", "left").join(agents.withColumn("_a", F.lit(True)), "agent_id", "left").filter(F.col("_t") | F.col("_a")).select(*batch.columns)
        )
        visits = settled(self.score(seen).join(touched, "account_id", "left_semi"))
        predictions = settled(geocode.geocode_accounts(replace(self.inputs, visits=visits), touched, self.described))
        predictions.write.mode("overwrite").parquet(f"{self.root}/predictions/batch={batch_id}")
        places.merge_locations(self._events(visits, predictions)).drop("confirmed", "predicted").write.mode("overwrite").parquet(f"{self.root}/locations/batch={batch_id}")

    @staticmethod
    def _events(visits: DataFrame, predictions: DataFrame) -> DataFrame:
        """Confirmed visits, and the new predictions as of each account's newest visit."""
        confirmed = visits.filter(F.col("outcome").isin(*config.CANONICAL_SUCCESS)).select(
            "account_id", F.col("visit_id").alias("event_id"), F.col("checkin_ts").alias("ts"), F.col("latitude").alias("x"), F.col("longitude").alias("y"),
            F.col("reliability").alias("confidence"), F.col("gps_accuracy_m").alias("radius_m"), F.lit("visit_confirmed").alias("source"),
        )
        newest = visits.groupBy("account_id").agg(F.max("checkin_ts").alias("ts"), F.max("visit_id").alias("event_id"))
        told = predictions.filter("pred_lat is not null").join(newest, "account_id").select(
            "account_id", "event_id", "ts", F.col("pred_lat").alias("x"), F.col("pred_lon").alias("y"), "confidence",
            F.col("confidence_radius_m").cast("double").alias("radius_m"), F.lit("prediction").alias("source"),
        )
        return confirmed.unionByName(told)

    def latest(self, name: str) -> DataFrame:
        """The newest row of every account in ``predictions`` or ``locations``."""
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        columns = [c for c in rows.columns if c not in ("batch", "account_id")]
        return rows.groupBy("account_id").agg(F.max_by(F.struct(*columns), "batch").alias("_l")).select("account_id", "_l.*")
