"""Ranked text lookup over DataFrames: reading indexes, matching, fusion, a keyed store."""
