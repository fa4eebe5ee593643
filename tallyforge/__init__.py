"""Reconciliation of priced and unpriced bills of quantities as Spark plans."""
