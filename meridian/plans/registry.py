"""All registered queries of the weather operators, and the SQL that each must agree with."""

from . import control, fields, quality, requests, storage  # noqa: F401  they register themselves
from .book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
