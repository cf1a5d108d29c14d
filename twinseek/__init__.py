"""Near-duplicate units (functions, paragraphs, documents) on Spark DataFrames."""

from twinseek.operators.match import match_units
from twinseek.operators.thresholds import ThresholdConfig
from twinseek.session import build_session

__all__ = ["ThresholdConfig", "build_session", "match_units"]
