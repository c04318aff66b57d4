"""Reading and writing the domain's tables: typed CSV splits, JSON columns, results and artifacts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewise.functions import sha256
from placewise.session import ensure_checkpoint_dir

# Id column(s) and schema of each split table (fixed values).
SPLIT_TABLES = {
    "towns": (["town_id"], "town_id string, town_name string, address_style string, approx_radius_m double"),
    "localities": (["locality_id"], "locality_id string, town_id string, locality_name string, pincode string, centroid_x double, centroid_y double"),
    "landmarks_poi": (["poi_id"], "poi_id string, town_id string, landmark_type string, name string, x double, y double"),
    "baseline_geocodes": (["address_id"], "address_id string, geocoder_x double, geocoder_y double, precision string"),
    "surveyed_addresses": (["address_id"], "address_id string, surveyed_x double, surveyed_y double"),
    "visit_gps_points": (["visit_id", "seq"], "visit_id string, seq int, point_ts string, x double, y double, accuracy_m double"),
    "accounts": (
        ["account_id"],
        "account_id string, lender_id string, portfolio string, income_type string, town_id string, preferred_language string, bucket_start string, "
        "dpd_start int, emi_amount double, overdue_start double, outstanding double, salary_credit_day double, bureau_score_band string, "
        "other_active_loans int, paid_other_lenders_30d string, last_bounce_reason string, ability_to_pay_estimate double, prev_ptp_count int, "
        "prev_ptp_broken int, dialling_arm string",
    ),
    "addresses": (["address_id"], "address_id string, account_id string, address_type string, source string, added_date string, town_id string, address_text string"),
    "field_visits": (
        ["visit_id"],
        "visit_id string, account_id string, address_id string, agent_id string, visit_date string, start_ts string, checkin_ts string, checkin_x double, "
        "checkin_y double, gps_accuracy_m double, dwell_s int, outcome string, ptp_id string, remark string, photo_hash string",
    ),
    "agents": (["agent_id"], "agent_id string, channel string, language_team string, town_id string, tenure_months double, shift string"),
}
REQUIRED_FOR_EVALUATION = ("addresses", "field_visits", "surveyed_addresses", "baseline_geocodes", "towns")


def split_path(root: str, table: str, split: str) -> str:
    return f"{root}/{table}/{table}_{split}.csv"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_split(spark: SparkSession, root: str, table: str, split: str = "train") -> DataFrame:
    """One typed table. A missing file is an empty table; a repeated id keeps its last row; GPS points keep all."""
    keys, schema = SPLIT_TABLES[table]
    path = split_path(root, table, split)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    if table == "visit_gps_points":
        return rows
    ordered = rows.withColumn("_line", F.monotonically_increasing_id())
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("_line").desc()))
    out = ordered.withColumn("_n", last).filter("_n = 1").drop("_n", "_line")
    if table == "accounts":
        out = out.withColumn("paid_other_lenders_30d", F.coalesce(F.col("paid_other_lenders_30d") == "True", F.lit(False)))
    if table == "agents":
        out = out.fillna(0.0, ["tenure_months"])
    if table == "field_visits":
        for column in ("start_ts", "checkin_ts"):
            out = out.withColumn(column, F.to_timestamp_ntz(F.replace(F.col(column), F.lit("T"), F.lit(" "))))
    return out


def require_inputs(spark: SparkSession, root: str, split: str, tables: Sequence[str] = REQUIRED_FOR_EVALUATION) -> None:
    """Fail before any job, naming every missing input."""
    missing = [p for p in (split_path(root, t, split) for t in tables) if not _exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing evaluation inputs: " + ", ".join(missing))


# Larger files are hashed block by block, each block in a task of its own.
BLOCK_BYTES = 512 << 20


def fingerprints(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """path, sha256, length of each file; one task per file, or per block of a large file."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(list(paths))
    whole = files.filter(F.col("length") <= BLOCK_BYTES).select("path", F.sha2("content", 256).alias("sha256"), "length")
    large = files.filter(F.col("length") > BLOCK_BYTES).select("path", "length").collect()
    chained = [(r.path, _hash_of_blocks(spark, r.path, r.length), r.length) for r in large]
    return whole.unionByName(spark.createDataFrame(chained, "path string, sha256 string, length long")) if chained else whole


def _hash_of_blocks(spark: SparkSession, path: str, length: int) -> str:
    """SHA-256 of one large file: its blocks are hashed in turn, each going on from the state of the one before.

    The text reader cuts a file of any size into splits and returns the bytes between line feeds
    unchanged; they are written once, by block, so that a task reads its own block only.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("line")
    )
    folder = f"{ensure_checkpoint_dir(spark)}/blocks-{uuid.uuid4().hex}"
    lines.withColumn("block", F.floor(F.col("start") / BLOCK_BYTES)).write.partitionBy("block").parquet(folder)
    state, done = sha256.start(), 0
    for block in range(-(-length // BLOCK_BYTES)):
        if not _exists(spark, f"{folder}/block={block}"):  # Inside one line.
            continue
        part = spark.read.parquet(f"{folder}/block={block}").repartition(1).sortWithinPartitions("start", "row")
        row = part.select("line").mapInArrow(sha256.going_on(state, done), "state binary, done long").first()
        state, done = bytes(row.state), row.done
    if done < length:  # The last line feed ends the file.
        state, done = sha256.update(state, b"\n"), done + 1
    if done != length:
        raise ValueError(f"{path}: {done} of {length} bytes read")
    return sha256.finish(state)


def append_predictions(predictions: DataFrame, path: str, ts: str = "ts") -> None:
    """Append with nested columns kept; one folder per day."""
    predictions.withColumn("dt", F.to_date(ts)).write.mode("append").partitionBy("dt").parquet(path)


def write_artifact(metrics: DataFrame, path: str, run_id: str, settings: dict, inputs: DataFrame | None = None) -> None:
    """Versioned run: a tidy metrics table, the input hashes and one JSON row describing the run."""
    spark = metrics.sparkSession
    metrics.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{path}/{run_id}/metrics")
    if inputs is not None:
        inputs.write.mode("overwrite").parquet(f"{path}/{run_id}/inputs")
    spark.createDataFrame([(run_id, json.dumps(settings, sort_keys=True))], "run_id string, settings string").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/{run_id}/run")


def cache_key(provider: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(provider, F.lit(":"), text), 256), 1, 32)


def reuse_geocodes(requests: DataFrame, results: DataFrame, providers: Sequence[str], as_of: Column, ttl_s: int = 86_400) -> DataFrame:
    """Earlier external results for each request text, from the first provider that has an unexpired one.

    ``requests``: request_id, text. ``results``: cache_key, latitude, longitude, cached_at.
    """
    ranked = requests.select(
        "request_id", F.explode(F.array(*[F.struct(F.lit(i).alias("provider_rank"), cache_key(F.lit(p), F.col("text")).alias("cache_key"), F.lit(p).alias("provider")) for i, p in enumerate(providers)])).alias("_p")
    ).select("request_id", "_p.*")
    fresh = results.filter(F.col("cached_at") + F.make_dt_interval(secs=F.lit(ttl_s)) > as_of)
    hits = ranked.join(fresh, "cache_key")
    best = hits.groupBy("request_id").agg(
        F.min_by(F.struct("provider", "latitude", "longitude"), F.struct(F.col("provider_rank"), (-F.unix_micros(F.col("cached_at").cast("timestamp"))).alias("age"))).alias("_b")
    )
    return requests.join(best, "request_id", "left").select("request_id", "_b.provider", "_b.latitude", "_b.longitude")


def decode_json(column: str, schema: str) -> Column:
    """Nested value of a JSON text column; malformed text is null."""
    return F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})


def encode_json(column: str | Column) -> Column:
    return F.to_json(column)
