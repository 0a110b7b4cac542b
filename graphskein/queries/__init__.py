"""Registered queries and, where SQL can express them, their SQL."""
