"""Loads every query module and exposes the full list."""

from salience.plans import entity, evaluation, humans, judging, scores, texts  # noqa: F401
from salience.plans.registry import CHECK_SQL, QUERIES  # noqa: F401
