"""Registered queries with their SQL."""

from . import datasets, filtering, learning, naming, report, series, spectra, states, validation
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "datasets", "filtering", "learning", "naming", "report", "series", "spectra", "states", "validation"]
