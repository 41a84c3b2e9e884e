"""Relational operators of the ledger, over any DataFrame with its columns."""
