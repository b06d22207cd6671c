"""Structured Streaming fronts of the stateless operators."""
