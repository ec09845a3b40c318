"""Severity scale expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The severity scale, most severe first.
SEVERITIES = ["critical", "high", "medium", "low"]


def severity_rank(severity: Column) -> Column:
    """4 for critical down to 1 for low, any letter case; null for anything else."""
    rank = F.when(F.lower(severity) == SEVERITIES[0], 4)
    for weight, name in zip((3, 2, 1), SEVERITIES[1:]):
        rank = rank.when(F.lower(severity) == name, weight)
    return rank


def rank_severity(rank: Column) -> Column:
    """Inverse of ``severity_rank``; nothing found counts as low."""
    return (
        F.when(rank == 4, "critical").when(rank == 3, "high").when(rank == 2, "medium").otherwise("low")
    )


def finding_level(severity: Column) -> Column:
    """Three display levels: critical and high, medium, and everything else."""
    name = F.lower(severity)
    return F.when(name.isin("critical", "high"), "critical").when(name == "medium", "warning").otherwise("info")
