"""Ledger analytics on Spark: statements as text in, audited ledgers out."""
