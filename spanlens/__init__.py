"""Deterministic findings from career documents, as DataFrame operators."""
