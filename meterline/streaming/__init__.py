"""Replay-safe reading of session logs, in batch and as streams."""
