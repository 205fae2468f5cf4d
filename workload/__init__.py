"""The registered queries, each with the SQL that must give the same rows."""

from workload import log, rollups, series, storage, streams  # noqa: F401
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
