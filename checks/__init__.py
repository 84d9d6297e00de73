"""Registered queries over the given tables and the SQL that states their results."""

from checks.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
