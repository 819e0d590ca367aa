"""Registered queries: every operator applied to the given tables, with its SQL twin."""
