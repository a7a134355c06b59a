"""Every query of the library but those of the optional subpackage, and their SQL."""

from __future__ import annotations

from tessera.plans import assembly, assessment, changes, conversation, evaluation, evidence, figures, lifecycle, replies, retrieval, scheduling, validity

_FAMILIES = conversation, evidence, figures, changes, validity, assessment, replies, lifecycle, assembly, retrieval, evaluation, scheduling


def queries() -> dict:
    return {f.__name__: f for family in _FAMILIES for f in family.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, sql in family.SQL.items()}
