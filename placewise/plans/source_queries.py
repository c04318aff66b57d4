from pyspark.sql import functions as F

from placewise.plans.registry import query
from placewise.sources import tables


@query("a4_input_fingerprints")
def a4(t):
    out = tables.fingerprints(t.spark, t.sf_dir, glob="*.parquet")
    return out.select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256", "length")


_CACHE = """SELECT substr(sha256(concat(CASE WHEN b.address_id % 3 = 0 THEN 'primary' ELSE 'backup' END, ':', a.address_text)), 1, 32) AS cache_key, geocoder_x AS latitude, geocoder_y AS longitude,
 TIMESTAMP '2024-01-10 00:00:00' + to_hours(CAST(b.address_id % 40 AS INT)) AS cached_at FROM v_baseline b JOIN v_addresses a ON a.address_id = b.address_id"""


@query(
    "a8_geocode_reuse",
    f"""WITH c AS ({_CACHE}), h AS (SELECT a.address_id AS request_id, p.provider, c.latitude, c.longitude, row_number() OVER (PARTITION BY a.address_id ORDER BY p.rank, c.cached_at DESC) AS rn
 FROM v_addresses a CROSS JOIN (SELECT 0 AS rank, 'primary' AS provider UNION ALL SELECT 1, 'backup') p JOIN c ON c.cache_key = substr(sha256(concat(p.provider, ':', a.address_text)), 1, 32)
 WHERE c.cached_at + INTERVAL 86400 SECOND > TIMESTAMP '2024-01-11 12:00:00')
SELECT a.address_id AS request_id, h.provider, h.latitude, h.longitude FROM v_addresses a LEFT JOIN h ON h.request_id = a.address_id AND h.rn = 1""",
)
def a8(t):
    requests = t.addresses.select(F.col("address_id").alias("request_id"), F.col("address_text").alias("text"))
    provider = F.when(F.col("address_id") % 3 == 0, "primary").otherwise("backup")
    results = t.baseline.join(t.addresses, "address_id").select(
        tables.cache_key(provider, F.col("address_text")).alias("cache_key"), F.col("geocoder_x").alias("latitude"), F.col("geocoder_y").alias("longitude"),
        (F.lit("2024-01-10 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("address_id") % 40).cast("int"))).alias("cached_at"),
    )
    as_of = F.lit("2024-01-11 12:00:00").cast("timestamp_ntz")
    return tables.reuse_geocodes(requests, results, ["primary", "backup"], as_of)


@query("a9_json_column", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def a9(t):
    return t.events.select("event_id", tables.decode_json("props", "k long")["k"].alias("k"))
