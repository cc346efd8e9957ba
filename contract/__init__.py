"""Registered queries on the driver's tables, each with its independent SQL where SQL can say it."""

from contract import drift, flows, ingest, models, quality, series  # noqa: F401 - importing registers
from contract.registry import QUERIES

__all__ = ["QUERIES"]
