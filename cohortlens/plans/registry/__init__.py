"""Queries by inventory id and their SQL."""

from cohortlens.plans.registry import (  # noqa: F401
    aggregates,
    evaluation,
    functions,
    indicators,
    joins,
    models,
    prepare,
    projections,
    selection,
    storage,
    windows,
)
from cohortlens.plans.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
