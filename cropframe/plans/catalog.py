"""The registered query catalogue (imports every query module once)."""

from __future__ import annotations

from cropframe.plans import q_climate, q_features, q_integrate, q_models, q_temporal  # noqa: F401
from cropframe.plans.registry import ORACLE, QUERIES, SURVEY_IDS


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}


def survey_ids():
    return dict(SURVEY_IDS)
