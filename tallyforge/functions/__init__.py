"""Scalar rules as column expressions; everything here stays inside generated code."""
