"""Named queries over the tables of a data directory, with their SQL counterparts."""

from . import checks, files, learned, models, reports, rules, streams, studies  # noqa: F401  register their queries
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
