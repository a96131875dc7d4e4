"""Readers for office packages (standard library only, run in Python workers)."""
