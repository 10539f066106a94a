"""Half-open intervals [from, to), and provenance, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def since(start: Column) -> tuple[Column, Column]:
    """An open interval."""
    return start, F.lit(None).cast("long")


def between(start: Column, stop: Column) -> tuple[Column, Column]:
    return start, stop


def contains(t: Column | int, start: str = "valid_from", stop: str = "valid_to") -> Column:
    """Whether the interval covers t; an inverted or zero-width one covers nothing."""
    at = F.lit(t) if isinstance(t, int) else t
    return (F.col(start) <= at) & (F.col(stop).isNull() | (at < F.col(stop)))


def is_empty(start: str = "valid_from", stop: str = "valid_to") -> Column:
    return F.coalesce(F.col(stop) <= F.col(start), F.lit(False))


def provenance(source: Column, observed_at: Column, source_ref: Column) -> Column:
    return F.struct(source.alias("source"), observed_at.alias("observed_at"), source_ref.alias("source_ref"))
