"""Judging answers against known ones."""
