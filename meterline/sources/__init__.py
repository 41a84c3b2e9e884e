"""Inputs of the ledger."""
