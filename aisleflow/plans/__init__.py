"""Registered queries, grouped by theme, each with its checking SQL."""

PLAN_MODULES = ["adhoc", "quality_checks", "daily_facts", "calendar_promos", "series_windows", "lookups", "feature_blocks", "evaluation", "forecasting"]
