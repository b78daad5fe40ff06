"""Exports: CSV, JSON, Markdown report, API envelope."""
