"""Ordered checks, closed on missing values, and small scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Evidence tiers from lowest to highest (fixed values).
TIERS = ("none", "system", "train_only", "validation", "sealed_test")


def first_failure(checks: list[tuple[Column, str]], passed: str) -> Column:
    """The reason of the first condition that holds; a condition that is null holds, as nothing may pass unknown."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(reason)) for bad, reason in checks], F.lit(passed))


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def tier_rank(tier: Column) -> Column:
    """Null for an unknown tier."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(TIERS, range(len(TIERS)), strict=True) for x in pair]), tier)


def is_digest(c: Column) -> Column:
    return holds(c.rlike(r"\A[0-9a-f]{64}\z"))


def is_run_id(c: Column) -> Column:
    return holds(c.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._\-]{0,127}\z"))


def escapes(path: Column) -> Column:
    """Whether a relative path is absolute or leaves its root."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.coalesce(clean.rlike(r"\A/|\A[A-Za-z]:") | F.array_contains(F.split(clean, "/"), ".."), F.lit(True))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
