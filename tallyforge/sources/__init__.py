"""Workbook sources."""
