"""Operators: plain ``DataFrame (+ params) -> DataFrame`` functions."""

from . import aggregates, bind, dedup, events, filters, migrate, paging, project, rules, windows

__all__ = ["aggregates", "bind", "dedup", "events", "filters", "migrate", "paging", "project",
           "rules", "windows"]
