from pyspark.sql import functions as F

from placewise.operators import lookup
from placewise.plans.registry import query


@query(
    "b1_account_search",
    """
SELECT account_id, address, locality, pincode FROM v_accounts
WHERE address ILIKE '%nehru%' OR locality ILIKE '%nehru%' OR pincode ILIKE '%nehru%' OR city ILIKE '%nehru%'
ORDER BY account_id LIMIT 50""",
)
def b1(t):
    return lookup.search_accounts(t.accounts, "nehru").select("account_id", "address", "locality", "pincode")


@query(
    "b2_dataset_account_search",
    """
SELECT DISTINCT t.account_id, t.town_id FROM v_truth t LEFT JOIN v_addresses a ON a.account_id = t.account_id
WHERE contains(lower(CAST(t.account_id AS VARCHAR)), 'masjid') OR contains(lower(t.town_id), 'masjid') OR contains(lower(a.address_text), 'masjid')
ORDER BY t.account_id LIMIT 100 OFFSET 20""",
)
def b2(t):
    accounts = t.truth.select("account_id", "town_id")
    return lookup.search_dataset_accounts(accounts, t.addresses, "Masjid", offset=20)


_OUTCOME_CASE = """CASE outcome WHEN 'met_borrower' THEN 'SUCCESSFUL_CONTACT' WHEN 'cash_collected' THEN 'SUCCESSFUL_CONTACT'
    WHEN 'met_family' THEN 'PARTIAL_CONTACT' WHEN 'locked_premises' THEN 'FAILED_SEARCH' WHEN 'neighbour_says_shifted' THEN 'FAILED_SEARCH'
    WHEN 'address_not_traceable' THEN 'ADDRESS_NOT_TRACEABLE' WHEN 'no_such_person' THEN 'ADDRESS_NOT_TRACEABLE' ELSE 'OTHER' END"""


@query("b3_outcome_normalisation", f"SELECT visit_id, outcome, {_OUTCOME_CASE} AS canonical FROM v_visits")
def b3(t):
    return t.visits.select("visit_id", "outcome", lookup.canonical_outcome("outcome").alias("canonical"))


@query(
    "b4_successful_visits",
    "SELECT visit_id, account_id, outcome FROM v_visits WHERE outcome IN ('met_borrower', 'met_family', 'cash_collected')",
)
def b4(t):
    return t.visits.filter(lookup.is_success()).select("visit_id", "account_id", "outcome")


_NEWEST = """
SELECT {key}, visit_id, checkin_ts, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY checkin_ts DESC, visit_id DESC) AS INT) AS rank
  FROM v_visits {where}) WHERE rank <= {k}"""


@query("b5_newest_visits_by_account", _NEWEST.format(key="account_id", where="", k=100))
def b5(t):
    return lookup.newest_visits(t.visits, "account_id").select("account_id", "visit_id", "checkin_ts", "rank")


@query("b5_newest_visits_by_agent", _NEWEST.format(key="agent_id", where="", k=100))
def b5_agent(t):
    return lookup.newest_visits(t.visits, "agent_id").select("agent_id", "visit_id", "checkin_ts", "rank")


@query(
    "b6_visits_before_cutoff",
    _NEWEST.format(key="account_id", where="WHERE checkin_ts < TIMESTAMP '2024-01-15 00:00:00'", k=100),
)
def b6(t):
    cutoff = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return lookup.newest_visits(t.visits, "account_id", before=cutoff).select(
        "account_id", "visit_id", "checkin_ts", "rank"
    )


@query(
    "b7_town_gazetteer",
    """
SELECT g.* FROM (
  SELECT town_id, 'locality' AS kind, locality_id AS id, locality_name AS name FROM v_localities
  UNION ALL SELECT town_id, 'landmark', CAST(poi_id AS VARCHAR), name FROM v_landmarks) g
WHERE town_id IN (SELECT town_id FROM v_towns WHERE town_name = 'asia')""",
)
def b7(t):
    return lookup.gazetteer_of_town(t.towns, t.localities, t.landmarks, "Asia")


@query(
    "b8_account_detail",
    """
SELECT t.account_id, t.town_id, a.address_text, b.geocoder_x, s.surveyed_x, v.n_visits, v.visit_ids
FROM v_truth t JOIN v_addresses a ON a.account_id = t.account_id
LEFT JOIN v_baseline b ON b.address_id = a.address_id LEFT JOIN v_surveyed s ON s.address_id = a.address_id
LEFT JOIN (SELECT account_id, count(*) AS n_visits, string_agg(CAST(visit_id AS VARCHAR), ',' ORDER BY rn) AS visit_ids FROM (
   SELECT account_id, visit_id, row_number() OVER (PARTITION BY account_id ORDER BY checkin_ts DESC, visit_id DESC) AS rn FROM v_visits)
   WHERE rn <= 100 GROUP BY account_id) v ON v.account_id = t.account_id""",
)
def b8(t):
    detail = lookup.account_detail(
        t.truth.select("account_id", "town_id"), t.addresses.drop("town_id"), t.visits, t.baseline, t.surveyed
    )
    first = F.col("addresses")[0]
    return detail.select(
        "account_id",
        "town_id",
        first["address_text"].alias("address_text"),
        first["geocoder_x"].alias("geocoder_x"),
        first["surveyed_x"].alias("surveyed_x"),
        F.when(F.col("visits").isNotNull(), F.size("visits").cast("long")).alias("n_visits"),
        F.array_join(F.transform("visits", lambda v: v["visit_id"].cast("string")), ",").alias("visit_ids"),
    )


@query("b9_account_page", "SELECT account_id, town_id FROM v_truth ORDER BY account_id LIMIT 100 OFFSET 40")
def b9(t):
    return lookup.page(t.truth, ["account_id"], 40, 100).select("account_id", "town_id")
