"""Operators for preparing training text; nothing outside this folder imports it."""
