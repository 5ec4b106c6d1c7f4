"""Operators for preparing training text: extraction, filtering, matching, scoring, packing, archiving."""
