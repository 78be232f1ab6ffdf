"""When a stored stage can be used again."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import Grammar


def needs_rebuild(output: str, inputs: Iterable[str], force: bool = False) -> bool:
    """Whether a local output is missing or older than one of its inputs."""
    if force or not os.path.exists(output):
        return True
    made = os.path.getmtime(output)
    return any(os.path.exists(i) and os.path.getmtime(i) > made for i in inputs)


def same_configuration(stored: dict, grammar: Grammar, reference: str, genes: Iterable[str]) -> bool:
    """Whether a stored table was made with this grammar and reference, for these genes at least."""
    return (stored.get("spacer"), stored.get("pam"), stored.get("reference")) == (grammar.spacer, grammar.pam, reference) and set(genes) <= set(stored.get("genes", ()))


def guides_without_record(guides: DataFrame, found: DataFrame, reference_id) -> int:
    """If the reference is itself a record, every guide must stand in it: how many do not."""
    held = found.where(F.col("seq_id") == reference_id).select("guide_id")
    return guides.join(held, "guide_id", "left_anti").count()


def close_to(table: DataFrame, stored: DataFrame, key: str, column: str, tolerance: float = 1e-12) -> int:
    """Rows of a recomputed table that differ from the stored one by more than tolerance, or are in one only."""
    both = table.select(key, F.col(column).alias("_a")).join(stored.select(key, F.col(column).alias("_b")), key, "full")
    return both.where(F.col("_a").isNull() | F.col("_b").isNull() | (F.abs(F.col("_a") - F.col("_b")) > tolerance)).count()
