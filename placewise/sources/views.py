"""Domain tables derived from the benchmark's base tables.

The base tables hold no coordinates or addresses. These views derive them with
integer arithmetic only, so the same SQL gives the same rows in Spark and in
DuckDB. Each view is a lazy plan over the whole base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEW_SQL = {
    "v_towns": """
SELECT concat('T', r_regionkey) AS town_id, lower(r_name) AS town_name,
       CASE r_regionkey % 3 WHEN 0 THEN 'karnataka' WHEN 1 THEN 'hindi' ELSE 'metro' END AS address_style,
       CAST(4000 + 100 * r_regionkey AS DOUBLE) AS approx_radius_m
FROM region""",
    "v_localities": """
SELECT concat('L', n_nationkey) AS locality_id, concat('T', n_regionkey) AS town_id,
       concat(CASE n_nationkey % 5 WHEN 0 THEN 'Kuvempu' WHEN 1 THEN 'Nehru' WHEN 2 THEN 'Basava' WHEN 3 THEN 'Gandhi' ELSE 'Vinayaka' END,
              CASE n_nationkey % 3 WHEN 0 THEN ' Layout' WHEN 1 THEN ' Nagar' ELSE ' Colony' END,
              ' ', n_nationkey) AS locality_name,
       CAST(960100 + n_nationkey AS VARCHAR(6)) AS pincode,
       CAST((n_nationkey * 733) % 8000 - 4000 AS DOUBLE) AS centroid_x,
       CAST((n_nationkey * 397) % 8000 - 4000 AS DOUBLE) AS centroid_y, n_nationkey
FROM nation""",
    "v_truth": """
SELECT c.c_custkey AS address_id, c.c_custkey AS account_id, l.town_id, l.locality_id, l.locality_name, l.pincode,
       l.centroid_x + CAST((c.c_custkey % 9) * 40 - 160 AS DOUBLE) AS surveyed_x,
       l.centroid_y + CAST((c.c_custkey % 7) * 50 - 150 AS DOUBLE) AS surveyed_y
FROM customer c JOIN v_localities l ON c.c_nationkey % 8 = l.n_nationkey""",
    "v_addresses": """
SELECT address_id, account_id, town_id,
       concat('No. ', address_id % 400, ', ', address_id % 9 + 1, 'th Cross, ', address_id % 7 + 1, 'th Mn, ',
              CASE address_id % 6 WHEN 0 THEN 'opp Ganesh mandir, ' WHEN 1 THEN 'bhd govt school, ' WHEN 2 THEN 'near masjid, '
                   WHEN 3 THEN 'ration shop ke paas, ' WHEN 4 THEN 'Post Office Rd. ; ' ELSE '' END,
              locality_name, ' - ', pincode) AS address_text
FROM v_truth""",
    # What the address book says of each address besides its text.
    "v_address_book": """
SELECT address_id, CASE address_id % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'office' WHEN 2 THEN 'permanent' ELSE 'reference' END AS address_type,
       CASE address_id % 3 WHEN 0 THEN 'application' WHEN 1 THEN 'bureau' ELSE 'skip_trace' END AS source
FROM v_truth""",
    "v_surveyed": """
SELECT address_id, surveyed_x, surveyed_y FROM v_truth WHERE address_id % 3 = 0""",
    "v_baseline": """
SELECT address_id,
       surveyed_x + CAST((address_id * 91) % 901 - 450 AS DOUBLE) AS geocoder_x,
       surveyed_y + CAST((address_id * 57) % 701 - 350 AS DOUBLE) AS geocoder_y,
       CASE WHEN address_id % 10 < 6 THEN 'locality' WHEN address_id % 10 < 8 THEN 'street' WHEN address_id % 10 = 8 THEN 'pincode' ELSE 'rooftop' END AS "precision"
FROM v_truth WHERE address_id % 13 <> 0""",
    "v_landmarks": """
SELECT p_partkey AS poi_id, concat('T', p_partkey % 5) AS town_id,
       CASE p_partkey % 7 WHEN 0 THEN 'ganesha_temple' WHEN 1 THEN 'govt_school' WHEN 2 THEN 'masjid' WHEN 3 THEN 'ration_shop'
            WHEN 4 THEN 'post_office' WHEN 5 THEN 'park' ELSE 'bus_stop' END AS landmark_type,
       concat(CASE p_partkey % 7 WHEN 0 THEN 'Ganesh Temple' WHEN 1 THEN 'Govt School' WHEN 2 THEN 'Masjid' WHEN 3 THEN 'Ration Shop'
            WHEN 4 THEN 'Post Office' WHEN 5 THEN 'Park' ELSE 'Bus Stop' END, ' ', p_size) AS name,
       CAST((p_partkey * 733) % 8000 - 4000 AS DOUBLE) AS x,
       CAST((p_partkey * 397) % 8000 - 4000 AS DOUBLE) AS y
FROM part""",
    "v_visits": """
SELECT e.event_id AS visit_id, e.user_id AS account_id, e.user_id AS address_id,
       concat('A', e.event_id % 20) AS agent_id, e.ts AS checkin_ts,
       CASE WHEN e.event_id % 11 = 0 THEN CAST((e.event_id % 20) * 300 - 3000 AS DOUBLE)
            ELSE t.surveyed_x + CAST((e.event_id * 53) % 121 - 60 AS DOUBLE) END AS checkin_x,
       CASE WHEN e.event_id % 11 = 0 THEN CAST((e.event_id % 20) * 200 - 2000 AS DOUBLE)
            ELSE t.surveyed_y + CAST((e.event_id * 29) % 121 - 60 AS DOUBLE) END AS checkin_y,
       CAST(5 + (e.event_id * 17) % 140 AS DOUBLE) AS gps_accuracy_m,
       CAST(floor(e.value * 6) AS INT) AS dwell_s,
       CASE e.event_type WHEN 'purchase' THEN 'cash_collected' WHEN 'signup' THEN 'met_borrower' WHEN 'view' THEN 'met_family'
            WHEN 'click' THEN 'locked_premises' ELSE 'address_not_traceable' END AS outcome
FROM events e JOIN v_truth t ON e.user_id = t.address_id""",
    "v_gps_points": """
SELECT visit_id, seq, checkin_x - CAST((4 - seq) * (10 + visit_id % 30) AS DOUBLE) AS x,
       checkin_y - CAST((4 - seq) * (visit_id % 17) AS DOUBLE) AS y,
       CAST(seq * (5 + visit_id % 40) AS BIGINT) AS offset_s
FROM v_visits CROSS JOIN (SELECT 0 AS seq UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) s""",
    "v_contact_log": """
SELECT event_id AS id, user_id AS account_id, ts AS attempted_at,
       CASE event_type WHEN 'click' THEN 'SMS' WHEN 'view' THEN 'WHATSAPP' WHEN 'purchase' THEN 'FIELD_VISIT' WHEN 'signup' THEN 'PHONE_CALL' ELSE 'EMAIL' END AS channel,
       CASE WHEN event_id % 97 = 0 THEN 'COMPLAINT' WHEN event_id % 2 = 0 THEN 'REACHED' ELSE 'NOT_REACHED' END AS outcome
FROM events""",
    # Operational accounts (WGS84). Every fifth account has no location yet.
    "v_accounts": """
SELECT t.account_id, a.address_text AS address, t.locality_name AS locality, t.pincode, w.town_name AS city, t.town_id,
       CASE WHEN t.account_id % 5 = 4 THEN NULL ELSE 12.97 + t.surveyed_y / 111000 END AS latitude,
       CASE WHEN t.account_id % 5 = 4 THEN NULL ELSE 77.59 + t.surveyed_x / 108168 END AS longitude,
       CASE WHEN t.account_id % 5 = 4 THEN NULL ELSE CAST(t.account_id % 100 AS DOUBLE) / 100 END AS confidence,
       CASE WHEN t.account_id % 5 = 4 THEN NULL ELSE CAST(50 + t.account_id % 400 AS DOUBLE) END AS confidence_radius_m,
       CASE WHEN t.account_id % 5 = 4 THEN NULL ELSE concat('C', t.locality_id, '_', t.account_id % 63) END AS place_cluster_id
FROM v_truth t JOIN v_addresses a ON a.address_id = t.address_id JOIN v_towns w ON w.town_id = t.town_id""",
    # Predictions made over time for accounts: one per order of the account.
    "v_predictions": """
SELECT o.o_orderkey AS prediction_id, t.account_id,
       make_timestamp(2024, 1, 1 + CAST(o.o_orderkey % 28 AS INT), CAST(o.o_orderkey % 24 AS INT), 0, 0) AS ts,
       t.surveyed_x + CAST((o.o_orderkey * 37) % 401 - 200 AS DOUBLE) AS pred_x,
       t.surveyed_y + CAST((o.o_orderkey * 71) % 301 - 150 AS DOUBLE) AS pred_y,
       CAST((o.o_orderkey * 7) % 101 AS DOUBLE) / 100 AS confidence,
       CAST(50 + (o.o_orderkey * 13) % 400 AS DOUBLE) AS confidence_radius_m
FROM orders o JOIN v_truth t ON o.o_custkey = t.account_id""",
    # Place clusters kept by the service: the shared exact locations, with members.
    "v_clusters": """
SELECT concat('C', locality_id, '_', account_id % 63) AS cluster_id,
       CAST(12.97 + min(surveyed_y) / 111000 AS DOUBLE) AS latitude,
       CAST(77.59 + min(surveyed_x) / 108168 AS DOUBLE) AS longitude,
       count(*) AS n_members
FROM v_truth GROUP BY locality_id, account_id % 63""",
    "v_audit": """
SELECT event_id AS id, ts, concat('user_', user_id % 17) AS actor_id, upper(event_type) AS action,
       CASE WHEN event_id % 2 = 0 THEN 'account' ELSE 'visit' END AS resource_type, concat('r', user_id) AS resource_id,
       CASE WHEN event_id % 19 = 0 THEN 'DENIED' WHEN event_id % 23 = 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS outcome
FROM events""",
    "v_tasks": """
SELECT o_orderkey AS id, o_custkey AS account_id,
       CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderkey % 5000 AS DOUBLE) END AS execution_time_ms
FROM orders""",
}

_REF = re.compile(r"\b(v_[a-z_]+)\b")


def required_views(sql: str) -> list[str]:
    """Views a statement needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _REF.findall(text):
            if name in VIEW_SQL and name not in order:
                visit(VIEW_SQL[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def _spark_dialect(sql: str) -> str:
    sql = sql.replace('"precision"', "`precision`")
    # Spark's make_timestamp yields a zoned timestamp; the tables hold zone-free ones.
    return sql.replace("make_timestamp(", "make_timestamp_ntz(")


def duckdb_sql(select: str) -> str:
    """Stand-alone DuckDB statement: the views it needs as CTEs, then ``select``."""
    names = required_views(select)
    body = select.strip()
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in names)
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{ctes},\n{body[len(head):]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """Lazy access to base tables and derived views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._cache:
            sql = _spark_dialect(VIEW_SQL[name])
            inputs = {}
            for ref in set(_REF.findall(VIEW_SQL[name])):
                if ref in VIEW_SQL:
                    inputs[ref] = self.view(ref)
            for table in BASE_TABLES:
                if re.search(rf"\bFROM {table}\b|\bJOIN {table}\b", VIEW_SQL[name]):
                    inputs[table] = self.base(table)
            for ref in sorted(inputs, key=len, reverse=True):
                sql = re.sub(rf"(FROM|JOIN) {ref}\b", rf"\1 {{{ref}}}", sql)
            self._cache[name] = self.spark.sql(sql, **inputs)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if f"v_{name}" in VIEW_SQL:
            return self.view(f"v_{name}")
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)
