"""Named queries over the standard tables, each with its SQL where one exists."""

from . import data_queries, insight_queries, log_queries, model_queries, service_queries, text_queries  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
