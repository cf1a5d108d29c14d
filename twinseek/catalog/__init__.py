"""Named queries over the given tables, each with its SQL twin where SQL can say the same."""

from twinseek.catalog import evaluation, extraction, indexing, matching, pairing, reporting  # noqa: F401
from twinseek.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
