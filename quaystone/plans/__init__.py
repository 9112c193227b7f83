"""Checks on Catalyst plans before a statement runs."""
