"""Operators bound to the given tables: one query per inventory entry, with its SQL twin."""

from helixframe.plans.registry import load_all

__all__ = ["load_all"]
