"""Structured Streaming entry points of the operators."""
