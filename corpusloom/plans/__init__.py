"""Named queries over the test tables, each with SQL that gives the same rows where SQL can express it."""

from corpusloom.plans.catalogue import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
