"""All queries outside the optional subpackage, with their SQL."""

from __future__ import annotations

from loomstone.plans import base, core, ingest, more, problems  # noqa: F401 - importing these registers their queries


def queries() -> dict:
    return problems.QUERIES | base.QUERIES


def oracle_sql() -> dict[str, str]:
    return problems.SQL | base.SQL
