"""All checks, by importing the modules that register them."""

from surveyloom.checks import flows, quality, scalars, tables  # noqa: F401
from surveyloom.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
