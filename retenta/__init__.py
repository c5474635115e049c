"""Supporter-retention analytics as PySpark DataFrame jobs."""

from .period import Period
from .vocab import DEFAULT_VOCABULARY, Vocabulary

__all__ = ["DEFAULT_VOCABULARY", "Period", "Vocabulary"]
