"""All queries by name, and the SQL each is held against."""

from turnstile.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
