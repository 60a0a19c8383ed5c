"""Tamper-evident ledger analytics on PySpark DataFrames."""
