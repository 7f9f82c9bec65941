"""Whole queries composed from sources, functions and operators."""
