"""Thresholds shared by the operators. All of them are fixed values of the domain."""

from __future__ import annotations

from dataclasses import dataclass, field

# Raw field outcome -> canonical outcome (fixed values).
OUTCOME_MAP = {
    "met_borrower": "SUCCESSFUL_CONTACT",
    "met_family": "PARTIAL_CONTACT",
    "locked_premises": "FAILED_SEARCH",
    "address_not_traceable": "ADDRESS_NOT_TRACEABLE",
    "no_such_person": "ADDRESS_NOT_TRACEABLE",
    "cash_collected": "SUCCESSFUL_CONTACT",
    "neighbour_says_shifted": "FAILED_SEARCH",
}
RAW_SUCCESS = ("met_borrower", "met_family", "cash_collected")
CANONICAL_SUCCESS = ("SUCCESSFUL_CONTACT", "PARTIAL_CONTACT")

# Weight of an outcome in the reliability score (fixed values).
RELIABILITY_OUTCOME_WEIGHT = {
    "SUCCESSFUL_CONTACT": 1.0,
    "PARTIAL_CONTACT": 0.7,
    "FAILED_SEARCH": 0.2,
    "ADDRESS_NOT_TRACEABLE": 0.1,
    "WRONG_ADDRESS": 0.05,
    "BORROWER_MOVED": 0.1,
    "OTHER": 0.3,
}
# Weight of an outcome in the candidate centroid (fixed values).
CENTROID_OUTCOME_WEIGHT = {
    "SUCCESSFUL_CONTACT": 1.0,
    "PARTIAL_CONTACT": 0.7,
    "FAILED_SEARCH": 0.1,
    "ADDRESS_NOT_TRACEABLE": 0.05,
    "WRONG_ADDRESS": 0.0,
    "BORROWER_MOVED": 0.1,
    "OTHER": 0.3,
}
# Share of each part in the reliability score (fixed values).
RELIABILITY_WEIGHTS = {
    "gps_accuracy": 0.20,
    "dwell_time": 0.15,
    "outcome": 0.25,
    "trajectory": 0.15,
    "agent_reliability": 0.10,
    "consistency": 0.10,
    "distance_consistency": 0.05,
}
# Score lost per integrity finding (fixed values).
INTEGRITY_PENALTY = {
    "repeated_coordinates": 0.3,
    "shared_coordinates": 0.15,
    "near_agent_home": 0.25,
    "common_meeting_point": 0.3,
    "extremely_short_visit": 0.2,
    "impossible_speed": 0.4,
    "gps_jumps": 0.15,
    "identical_trajectories": 0.35,
    "highly_similar_trajectory": 0.2,
    "poor_gps_accuracy": 0.15,
    "pattern_short_visits": 0.2,
    "unusual_timing": 0.1,
}


@dataclass(frozen=True)
class CandidateRules:
    history_limit: int = 100
    group_radius_m: float = 50.0
    per_source: int = 10
    dedup_radius_m: float = 50.0
    keep: int = 20
    fuzzy_threshold: float = 70.0


@dataclass(frozen=True)
class ActionRules:
    direct_confidence: float = 0.85
    verify_confidence: float = 0.60
    direct_radius_m: float = 100.0
    verify_radius_m: float = 500.0


@dataclass(frozen=True)
class FusionRules:
    accuracy_m: float = 250.0
    coverage: float = 0.80
    rayleigh_median: float = 1.1774
    poi_radius_m: float = 600.0
    label_cut_m: float = 1500.0
    min_locality_points: int = 6
    cluster_link_m: float = 150.0
    min_sigma_observations: int = 8
    prior_reliability: dict = field(
        default_factory=lambda: {
            "met_family": 0.94,
            "met_borrower": 0.88,
            "cash_collected": 0.92,
            "neighbour_says_shifted": 0.90,
            "locked_premises": 0.88,
            "no_such_person": 0.73,
        }
    )


@dataclass(frozen=True)
class ContactRules:
    utc_offset_minutes: int = 330
    window_start_h: int = 7
    window_end_h: int = 20
    quiet_start_h: int = 21
    quiet_end_h: int = 6
    max_day: int = 3
    max_week: int = 7
    max_fortnight: int = 10
    cooldown_days: int = 7


# Retention in days per data category and per purpose (fixed values).
CATEGORY_RETENTION_DAYS = {
    "IDENTITY": 2555,
    "CONTACT": 2555,
    "FINANCIAL": 2555,
    "LOCATION": 1095,
    "BIOMETRIC": 1095,
    "BEHAVIORAL": 1095,
    "DEMOGRAPHIC": 2555,
}
PURPOSE_RETENTION_DAYS = {
    "DEBT_COLLECTION": 2555,
    "LEGAL_COMPLIANCE": 2555,
    "FRAUD_PREVENTION": 1095,
    "SERVICE_IMPROVEMENT": 1095,
    "MARKETING": 730,
    "RESEARCH": 1095,
}
DEFAULT_RETENTION_DAYS = 1095

# A group with more rows than this is never sorted by one task alone.
HOT_GROUP_ROWS = 1_000_000
