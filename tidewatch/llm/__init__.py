"""Operators on records and texts that models wrote, read or are trained on. Nothing outside this folder imports it."""
