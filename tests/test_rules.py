"""Scores, contact rules, sources and streams on small exact cases."""

import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from placewise.operators import calibration, compliance, integrity, metrics, places
from placewise.plans import registry
from placewise.sources import tables
from placewise.sources.views import required_views


def test_catalogue_is_consistent():
    queries, sqls = registry.spark_queries(), registry.oracle_statements()
    assert set(sqls) <= set(queries)
    assert len(sqls) > 80
    assert required_views("SELECT * FROM v_surveyed") == ["v_localities", "v_truth", "v_surveyed"]


def test_error_summary(spark):
    df = spark.createDataFrame([(10.0, 50.0), (50.0, 50.0), (100.0, 100.0), (400.0, 500.0)], "error_m double, radius_m double")
    r = metrics.error_summary(df, radius="radius_m").first()
    assert (r.n, r.median_error_m, r.within_100m, r.coverage) == (4, 75.0, 0.75, 1.0)


def test_actions(spark):
    df = spark.createDataFrame([(0.9, 50.0), (0.9, 150.0), (0.7, 400.0), (0.5, 20.0), (0.7, 600.0)], "c double, r double")
    got = [x[0] for x in df.select(calibration.recommended_action("c", "r")).collect()]
    assert got == ["VISIT_DIRECTLY", "VERIFY_FIRST", "VERIFY_FIRST", "LOW_CONFIDENCE", "LOW_CONFIDENCE"]


def test_interpolation(spark):
    df = spark.createDataFrame([(0.0,), (15.0,), (20.0,), (99.0,)], "s double")
    got = [x[0] for x in df.select(calibration.interpolate(F.col("s"), [10.0, 20.0], [0.9, 0.5])).collect()]
    assert got == pytest.approx([0.9, 0.7, 0.5, 0.5])


def _log(spark, rows):
    schema = "id long, account_id long, channel string, attempted_at timestamp_ntz, outcome string, do_not_contact boolean, consented boolean, legal_notice boolean"
    return spark.createDataFrame(rows, schema)


def test_contact_rules(spark):
    day = dt.datetime(2024, 1, 3, 5, 0)  # Wednesday 10:30 local
    rows = [(i, 1, "SMS", day + dt.timedelta(minutes=i), "REACHED", False, False, False) for i in range(5)]
    rows.append((10, 2, "SMS", dt.datetime(2024, 1, 3, 16, 0), "REACHED", False, False, False))  # 21:30 local
    rows.append((11, 3, "SMS", day, "REACHED", True, False, False))
    rows.append((12, 3, "SMS", day + dt.timedelta(hours=1), "REACHED", True, False, True))
    rows.append((13, 4, "SMS", day, "COMPLAINT", False, False, False))
    rows.append((14, 4, "SMS", day + dt.timedelta(days=2), "REACHED", False, False, False))
    rows.append((15, 4, "SMS", day + dt.timedelta(days=7), "REACHED", False, False, False))
    got = {r.id: r for r in compliance.verdicts(_log(spark, rows)).collect()}
    kinds = {i: [v.type for v in r.violations] for i, r in got.items()}
    assert [kinds[i] for i in range(5)] == [[], [], [], ["DAILY_LIMIT_EXCEEDED"], ["DAILY_LIMIT_EXCEEDED"]]
    assert got[3].next_allowed_at == dt.datetime(2024, 1, 4, 1, 30)
    assert kinds[10] == ["OUTSIDE_CONTACT_HOURS", "QUIET_HOURS"]
    assert got[10].next_allowed_at == dt.datetime(2024, 1, 4, 1, 30)
    assert kinds[11] == ["DO_NOT_CONTACT"] and kinds[12] == []
    assert kinds[14] == ["REPEATED_AFTER_COMPLAINT"] and kinds[15] == []


def test_retention(spark):
    df = spark.createDataFrame([("LOCATION", "MARKETING"), ("IDENTITY", "MARKETING"), ("?", "?"), ("LOCATION", "DEBT_COLLECTION")], "category string, purpose string")
    assert [r[0] for r in df.select(compliance.retention_days("category", "purpose")).collect()] == [1095, 2555, 1095, 2555]


def test_confirmed_location_wins(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        (1, 1, t, 0.0, 0.0, 0.9, 5.0, "visit_confirmed"), (1, 2, t + dt.timedelta(days=1), 9.0, 9.0, 0.99, 5.0, "prediction"),
        (2, 3, t, 1.0, 1.0, 0.6, 5.0, "prediction"), (2, 4, t + dt.timedelta(days=1), 2.0, 2.0, 0.4, 5.0, "prediction"),
        (3, 5, t, 1.0, 1.0, 0.3, 5.0, "prediction"),
    ]
    df = spark.createDataFrame(rows, "account_id long, event_id long, ts timestamp_ntz, x double, y double, confidence double, radius_m double, source string")
    got = {r.account_id: (r.x, r.location_source) for r in places.merge_locations(df).collect()}
    assert got == {1: (0.0, "visit_confirmed"), 2: (1.0, "prediction")}


def test_read_split(spark, tmp_path):
    folder = tmp_path / "towns"
    folder.mkdir(parents=True)
    (folder / "towns_train.csv").write_text("town_id,town_name,address_style,approx_radius_m\nT1,A,metro,10\nT2,B,,20\nT1,C,hindi,30\n")
    rows = {r.town_id: r for r in tables.read_split(spark, str(tmp_path), "towns").collect()}
    assert rows["T1"].town_name == "C" and rows["T2"].address_style is None and len(rows) == 2
    assert tables.read_split(spark, str(tmp_path), "agents").count() == 0
    with pytest.raises(FileNotFoundError, match="addresses_train"):
        tables.require_inputs(spark, str(tmp_path), "train")


def test_malformed_json_is_null(spark):
    df = spark.createDataFrame([('{"k": 3}',), ("{bad",), (None,)], "j string")
    assert [r[0] for r in df.select(tables.decode_json("j", "k long")["k"]).collect()] == [3, None, None]


def _tracks(seed, n, spread):
    """Visits of two agents with tracks in a few dense knots and between them; some share a track, some lengths differ by a little."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sx, sy, ex, ey = (rng.choice([-300.0, 0.0, 41.0]) + rng.uniform(-spread, spread) for _ in range(4))
        rows.append((i, f"A{i % 2}", *(rows[-2][2:6] if i > 2 and rng.random() < 0.1 else (sx, sy, ex, ey)), rng.choice([500, 500, 500, 501, 5])))
    return rows


def _similar_by_pairs(rows):
    out = {}
    for v, agent, *t, n in rows:
        sims = [
            (2.0 - min(1.0, (math.hypot(t[0] - o[0], t[1] - o[1]) + math.hypot(t[2] - o[2], t[3] - o[3])) / 200) - abs(n - m) / max(n, m)) / 2
            for w, other, *o, m in rows if other == agent and w != v
        ]
        out[v] = (sum(x > 0.99 for x in sims), round(max([x for x in sims if 0.95 < x <= 0.99], default=0.0), 9))
    return out


@pytest.mark.parametrize("seed,spread", [(1, 3.0), (2, 12.0), (3, 40.0)])
def test_similar_trajectories_equal_all_pairs(spark, seed, spread):
    rows = _tracks(seed, 160, spread)
    schema = "visit_id long, agent_id string, start_a double, start_b double, end_a double, end_b double, n_points long"
    df = spark.createDataFrame(rows, schema)
    got = integrity.similar_trajectories(df.select("visit_id", "agent_id"), df.drop("agent_id"))
    assert {r.visit_id: (r.identical_trajectories, round(r.trajectory_similarity, 9)) for r in got.collect()} == _similar_by_pairs(rows)


def test_dense_tracks_meet_few_others(spark):
    """A street of tracks 3 m apart: each meets those within reach, not all of its 100 m block."""
    rows = [(i, "A", 3.0 * (i % 40), 3.0 * (i // 40), 3.0 * (i % 40), 3.0 * (i // 40)) for i in range(1600)]
    left = spark.createDataFrame(rows, "visit_id long, agent_id string, start_a double, start_b double, end_a double, end_b double")
    right = left.select("agent_id", *[F.col(c).alias(f"o_{c}") for c in left.columns[2:]])
    reach = min(integrity._REACHES_M)
    assert integrity._same_agent_pairs(left, right, reach).count() < 1600 * (4 * reach / 3 + 2) ** 2


def test_large_files_are_hashed_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "BLOCK_BYTES", 16_384)
    rng = random.Random(5)
    noise = rng.randbytes(40_000)
    texts = {"a": b"\n" + noise, "b": noise + b"\n\n", "c": b"\n\n\r\n" * 9000, "d": b"\0" * 30_000, "e": noise[:100]}
    for name, data in texts.items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    try:
        got = {r.path[-5]: (r.sha256, r.length) for r in tables.fingerprints(spark, str(tmp_path), glob="*.bin").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {name: (hashlib.sha256(data).hexdigest(), len(data)) for name, data in texts.items()}
