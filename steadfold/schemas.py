"""Declared schemas.  Raw snapshots are never read with inference."""

from __future__ import annotations

# historical snapshots: the narrow feature set
CHILD_RECORD_HIST = """
    record_id STRING, snapshot_year INT, measured_on DATE, birth_date DATE, sex STRING,
    height_cm DOUBLE, weight_kg DOUBLE, stunted BOOLEAN, wasted BOOLEAN, underweight BOOLEAN,
    category STRING, phm STRING, moh STRING
"""

# the rich collection adds maternal, household and feeding variables
CHILD_RECORD_RICH = CHILD_RECORD_HIST + """,
    maternal_age INT, maternal_education STRING, income_range STRING, family_size INT,
    occupation STRING, exclusive_bf BOOLEAN, bf_months INT, complementary_feeding STRING,
    meals_per_day INT, dietary_diversity INT, triposha BOOLEAN, vitamin_supp BOOLEAN,
    birth_weight_kg DOUBLE
"""

CONTEXT_ANNUAL = """
    year INT, area STRING, cpi DOUBLE, food_price DOUBLE, rainfall_mm DOUBLE,
    flood_events INT, outbreak_events INT
"""
SPLITS = "record_id STRING, split STRING"
PREDICTIONS = """
    record_id STRING, model_version STRING, probs MAP<STRING,DOUBLE>, predicted STRING,
    scored_at TIMESTAMP
"""
OUTCOMES = "record_id STRING, label STRING, label_ts TIMESTAMP"
FEATURE_BOUNDS = "feature STRING, lo DOUBLE, hi DOUBLE"
GATE_CRITERIA = "action STRING, metric STRING, class STRING, kind STRING, limit DOUBLE"
REGISTRY = "model_id STRING, seq BIGINT, version STRING, parent STRING, event STRING, ts TIMESTAMP"
EXPERIMENT_RESULTS = """
    scenario STRING, strategy STRING, phase STRING, metric STRING, class STRING, value DOUBLE,
    action STRING, gate STRING
"""
MOVE_POLICY = "feature STRING, from_value STRING, to_value STRING, cost DOUBLE, feasible BOOLEAN"
RESOURCE_RATE = "resource STRING, category STRING, per_case DOUBLE"

# role of every variable when the outcome is defined from body measurements
FEATURE_ROLES = {
    "record_id": "id", "snapshot_year": "id", "measured_on": "date", "birth_date": "date",
    "phm": "area", "moh": "area",
    "height_cm": "anthropometric", "weight_kg": "anthropometric",
    "stunted": "outcome", "wasted": "outcome", "underweight": "outcome", "category": "outcome",
    "sex": "upstream", "age_months": "upstream",
    "maternal_age": "upstream", "maternal_education": "upstream", "income_range": "upstream",
    "family_size": "upstream", "occupation": "upstream", "exclusive_bf": "upstream",
    "bf_months": "upstream", "complementary_feeding": "upstream", "meals_per_day": "upstream",
    "dietary_diversity": "upstream", "triposha": "upstream", "vitamin_supp": "upstream",
    "birth_weight_kg": "upstream",
}
