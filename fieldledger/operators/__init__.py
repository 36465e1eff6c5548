"""Relational operators of the ledger, each a function of DataFrames."""
