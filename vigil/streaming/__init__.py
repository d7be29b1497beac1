"""Stateful operators, as batch folds and as Structured Streaming queries."""
