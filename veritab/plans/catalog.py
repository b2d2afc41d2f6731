"""All queries of the library; importing the modules registers them."""

from . import calls, more, reports  # noqa: F401
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
