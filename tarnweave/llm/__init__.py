"""Training-data pipeline operators (mixing, scoring, dedup, filters).

Nothing else in the library imports this subpackage; the entry module adds its
queries only when the import succeeds.
"""
