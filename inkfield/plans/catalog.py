"""All named queries."""

from inkfield.plans import file_queries, record_queries, text_queries, vector_queries  # noqa: F401
from inkfield.plans.registry import ORACLES, QUERIES  # noqa: F401
