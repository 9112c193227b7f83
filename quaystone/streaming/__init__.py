"""Incremental upkeep from streams of landed files."""
