"""Imports every query module, so that the registry is complete."""

from textprep.plans import (  # noqa: F401
    queries_corpus,
    queries_evaluate,
    queries_mcq,
    queries_preference,
    queries_sources,
)
from textprep.plans.registry import CHECKS, QUERIES  # noqa: F401
