"""Column functions for subjects: ``id``, ``*`` or ``id#relation``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relgrove.plans.model import WILDCARD


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def subject_object(c: str | Column) -> Column:
    """The id before ``#``, or the whole id."""
    return F.split_part(_col(c), F.lit("#"), F.lit(1))


def subject_relation(c: str | Column) -> Column:
    """The relation after ``#``, or the empty string."""
    return F.split_part(_col(c), F.lit("#"), F.lit(2))


def is_userset(c: str | Column) -> Column:
    return _col(c).contains("#")


def is_wildcard(c: str | Column) -> Column:
    return _col(c) == WILDCARD


def as_userset(object_id: str | Column, relation: str | Column) -> Column:
    """``id#relation``; a string for ``relation`` is the relation's name."""
    rel = F.lit(relation) if isinstance(relation, str) else relation
    return F.concat(_col(object_id), F.lit("#"), rel)


def wildcard_first(c: str | Column) -> Column:
    """A key that sorts the wildcard before all other ids."""
    return F.struct(F.when(is_wildcard(c), 0).otherwise(1).alias("rank"), _col(c).alias("id"))
