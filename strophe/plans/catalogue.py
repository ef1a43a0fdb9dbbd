"""Every query of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import details, labels, outlines, records, relations, structures, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = texts.QUERIES | relations.QUERIES | structures.QUERIES | outlines.QUERIES | records.QUERIES | labels.QUERIES | details.QUERIES
ORACLE_SQL: dict[str, str] = texts.ORACLE_SQL | relations.ORACLE_SQL | structures.ORACLE_SQL | outlines.ORACLE_SQL | records.ORACLE_SQL | labels.ORACLE_SQL | details.ORACLE_SQL
