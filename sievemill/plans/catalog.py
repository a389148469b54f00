"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import q_models, q_sources, q_text, q_values

QUERIES = q_text.QUERIES | q_values.QUERIES | q_models.QUERIES | q_sources.QUERIES
ORACLES = q_text.ORACLES | q_values.ORACLES | q_models.ORACLES | q_sources.ORACLES
