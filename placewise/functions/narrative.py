"""Human-readable evidence and directions, built from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewise.functions.lexicon import RELATION_SENTENCES


def _whole(c: Column) -> Column:
    """A number without decimals, ties to even."""
    return F.bround(c.cast("double"), 0).cast("long").cast("string")


def candidate_evidence() -> Column:
    """Reasons for a candidate: visits, nearby accounts, geocoder distance, place cluster."""
    visits, nearby = F.col("supporting_visit_count"), F.col("nearby_account_support")
    cluster, geocoder = F.col("place_cluster_support"), F.col("commercial_geocoder_distance")
    accuracy = F.coalesce(F.col("gps_accuracy"), F.lit(0.0))
    reasons = F.array_compact(
        F.array(
            F.when(visits > 0, F.concat(visits.cast("string"), F.lit(" successful visits within "), _whole(accuracy), F.lit("m"))),
            F.when(nearby > 0, F.concat(nearby.cast("string"), F.lit(" nearby accounts confirm the location"))),
            F.when(geocoder < 1000, F.concat(F.lit("Commercial geocoder was "), _whole(geocoder), F.lit("m away"))),
            F.when(cluster > 0, F.concat(F.lit("Place cluster with "), cluster.cast("string"), F.lit(" accounts supports this location"))),
        )
    )
    return F.when(F.size(reasons) == 0, F.array(F.lit("Limited evidence available"))).otherwise(reasons)


def direction_steps(entities: str, landmark: str, locality: str, has_point: Column, max_steps: int = 8) -> Column:
    """Array of (instruction, landmark, relation, type): primary landmark, two more, the cross, the destination."""
    named = F.transform(
        F.filter(entities, lambda e: e["entity_type"].isin("LANDMARK", "STREET", "CROSS", "BUILDING")), lambda e: e["value"]
    )
    related = F.filter(entities, lambda e: (e["entity_type"] == "LANDMARK") & e["relation"].isNotNull())
    main, place = F.col(landmark), F.col(locality)
    listed = F.when(main.isNotNull() & ~F.array_contains(named, F.coalesce(main, F.lit(""))), F.array_prepend(named, main)).otherwise(named)
    listed = F.when((F.size(listed) == 0) & place.isNotNull(), F.array(place)).otherwise(listed)

    def relation_of(mark: Column) -> Column:
        return F.get(F.filter(related, lambda e: e["value"] == mark), F.lit(0))["relation"]

    def sentence(mark: Column, plain: Column) -> Column:
        rel = relation_of(mark)
        out = F.when(rel.isNull(), plain)
        for name, text in RELATION_SENTENCES.items():
            head, tail = text.split("{}")
            out = out.when(rel == name, F.concat(F.lit(head), mark, F.lit(tail)))
        return out.otherwise(F.concat(F.lit("Find "), mark, F.lit(".")))

    def step(kind: str, instruction: Column, mark: Column, rel: Column) -> Column:
        return F.struct(instruction.alias("instruction"), mark.alias("landmark"), rel.alias("relation"), F.lit(kind).alias("type"))

    nothing = F.lit(None).cast("string")
    first = F.transform(
        F.slice(listed, 1, 1),
        lambda m: step("go_to_landmark", sentence(m, F.concat(F.lit("Reach "), m, F.lit("."))), m, relation_of(m)),
    )
    more = F.transform(
        F.slice(listed, 2, 2),
        lambda m: step("pass_landmark", sentence(m, F.concat(F.lit("Continue towards "), m, F.lit("."))), m, relation_of(m)),
    )
    crosses = F.slice(F.filter(entities, lambda e: e["entity_type"] == "CROSS"), 1, 1)
    along = F.transform(
        crosses, lambda e: step("continue", F.concat(F.lit("Continue on "), e["value"], F.lit(".")), e["value"], nothing)
    )
    arrive = F.filter(
        F.array(step("destination", F.when(has_point, F.lit("The predicted location is approximately at this point.")), nothing, nothing)),
        lambda s: s["instruction"].isNotNull(),
    )
    return F.slice(F.concat(first, more, along, arrive), 1, max_steps)


def directions_text(steps: Column) -> Column:
    numbered = F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["instruction"]))
    return F.when(F.size(steps) == 0, "No directions available.").otherwise(F.array_join(numbered, "\n"))
