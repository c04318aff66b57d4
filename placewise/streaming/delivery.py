"""Deliveries of queued visits: several sinks from one micro-batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.streaming.visits import MAX_RETRIES, check_visits, route_failures


def attempted(queue: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """``queue`` after one attempt at each item: retries, route, last_error and failed_at.

    ``queue``: retries (before the attempt), attempted_at, http_status (null if there was no answer) and error.
    An answer from 200 to 299 is a success. An item whose failures reach ``max_retries`` is a
    dead letter with its last error and the time of it.
    """
    ok = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    told = F.when(F.col("http_status").isNotNull(), F.concat(F.lit("HTTP "), F.col("http_status"))).otherwise(F.coalesce("error", F.lit("Network error")))
    tried = queue.withColumns({"status": F.when(ok, "synced").otherwise("failed"), "retries": F.col("retries") + F.when(ok, 0).otherwise(1)})
    routed = route_failures(tried, max_retries)
    dead = F.col("route") == "dead_letter"
    return routed.withColumns({"last_error": F.when(dead, told), "failed_at": F.when(dead, F.col("attempted_at"))}).drop("status", "http_status", "error")


@dataclass
class Sinks:
    """Parquet folders under ``root``, one partition for each micro-batch; a replayed batch overwrites its own."""

    root: str

    def write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")


class QueueSinks(Sinks):
    """Each attempted item goes to ``synced``, ``pending`` or ``dead_letter``."""

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = attempted(batch).persist()
        try:
            for route in ("synced", "pending", "dead_letter"):
                own = rows.filter(F.col("route") == route).drop("route")
                self.write(own if route == "dead_letter" else own.drop("last_error", "failed_at"), route, batch_id)
        finally:
            rows.unpersist()


@dataclass
class VisitSinks(Sinks):
    """Checked visits go to ``accepted``, or with the reason to ``quarantine``."""

    accounts: DataFrame

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = check_visits(batch, self.accounts).persist()
        try:
            self.write(rows.filter("rejected is null").drop("rejected"), "accepted", batch_id)
            self.write(rows.filter("rejected is not null"), "quarantine", batch_id)
        finally:
            rows.unpersist()
