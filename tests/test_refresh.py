"""Refreshed predictions against a full recompute, for one and for several micro-batches."""

import pytest
from pyspark.sql import functions as F

from placewise.operators import trajectories
from placewise.plans import geocode
from placewise.plans.candidate_queries import geocode_inputs, scored
from placewise.session import settled
from placewise.sources.views import Tables
from placewise.streaming import refresh

SF = "/root/testdata/sf0.001"


def _rows(df):
    return {r.account_id: tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.withColumn("evidence", F.array_join("evidence", "; ")).collect()}


@pytest.mark.parametrize("batches", [1, 2])
def test_touched_accounts_equal_a_full_recompute(spark, tmp_path, batches):
    t = Tables(spark, SF)
    tracks = settled(trajectories.summarise(t.gps_points, "projected_xy"))
    score = lambda visits: scored(visits, tracks.join(visits.select("visit_id"), "visit_id", "left_semi"))
    inputs = geocode_inputs(t, visits=None)
    visits = settled(t.visits.filter("account_id % 3 <> 0"))
    handler = refresh.PredictionRefresh(spark, str(tmp_path / "p6"), inputs, score)
    cuts = [visits] if batches == 1 else [visits.filter("visit_id % 2 = 0"), visits.filter("visit_id % 2 = 1")]
    for batch_id, part in enumerate(cuts):
        handler(part, batch_id)
    handler(cuts[-1], batches - 1)  # a replayed batch
    whole = geocode.geocode_accounts(geocode.GeocodeInputs(**{**inputs.__dict__, "visits": settled(score(visits))}))
    last = {r.account_id for r in cuts[-1].select("account_id").distinct().collect()}
    want, got = _rows(whole), _rows(handler.latest("predictions").select(whole.columns))
    touched = {r.account_id for r in visits.select("account_id").distinct().collect()}
    assert set(got) == touched & set(want) and len(got) >= 8
    assert {k: got[k] for k in got if k in last} == {k: want[k] for k in got if k in last}
    assert handler.latest("locations").count() == len({k for k in got if got[k][4] is not None})
