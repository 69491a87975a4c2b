"""The registered queries: each operator bound to the sample tables, with its SQL twin."""

from plumbline.plans import curation, evaluating, intervals, joining, measures, models, numeric, sampling, selecting, stores, streams  # noqa: F401
from plumbline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
