"""Matching and pricing operators."""
