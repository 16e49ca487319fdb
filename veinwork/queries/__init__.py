"""All queries of the engine and their SQL, by name."""

from . import aggregates, columns, decisions, evidence, features, ingest, joins, modelling, raster, studies, validation
from .registry import ORACLES, QUERIES, oracles

__all__ = ["ORACLES", "QUERIES", "aggregates", "columns", "decisions", "evidence", "features", "ingest", "joins", "modelling", "oracles", "raster", "studies", "validation"]
