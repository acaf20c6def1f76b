"""Spending-ledger analytics on Spark DataFrames."""
