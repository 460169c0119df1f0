"""Ordered enumerations as string columns plus integer ranks.

Levels are compared by rank only; the names sort in a different order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names in rank order.
SENSITIVITY_LEVELS = ("public", "internal", "confidential", "restricted", "secret")
INJECTION_RISKS = ("none", "low", "medium", "high", "critical")
ACCESS_RIGHTS = ("read", "write", "aggregate", "export", "admin")
AGENT_STATUSES = ("eligible", "ineligible", "blocked")

PUBLIC, INTERNAL, CONFIDENTIAL, RESTRICTED, SECRET = range(5)
NONE, LOW, MEDIUM, HIGH, CRITICAL = range(5)

# Fixed value: identifiers that may enter a filter template or an audit record.
SAFE_IDENTIFIER = r"\A[A-Za-z0-9_\-\.]{1,128}\z"


def name_to_rank(name: Column, names: tuple[str, ...] = SENSITIVITY_LEVELS) -> Column:
    """Rank of a level name; null for an unknown name, so that callers fail closed."""
    position = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return F.when(position > 0, (position - 1).cast("int"))


def rank_to_name(rank: Column, names: tuple[str, ...] = SENSITIVITY_LEVELS) -> Column:
    """Level name of a rank; null when the rank is out of range."""
    return F.get(F.array(*[F.lit(n) for n in names]), rank)


def is_safe_identifier(value: Column) -> Column:
    """True for an identifier of safe characters only; a null is unsafe."""
    return F.coalesce(value.rlike(SAFE_IDENTIFIER), F.lit(False))


def are_safe_identifiers(values: Column) -> Column:
    """True when every element of an array is safe; a null array is empty."""
    return F.coalesce(F.forall(values, is_safe_identifier), F.lit(True))
