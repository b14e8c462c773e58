"""Operators on DataFrames: filters, reviews, counts, rules, checks, profiles, extraction, measurement."""
