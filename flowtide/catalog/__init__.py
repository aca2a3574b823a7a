"""The registered queries, by area."""

from flowtide.catalog import aggregates, filters, mixed, scalars, storage, timeslots, work  # noqa: F401
from flowtide.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
