"""Training-data operators: dedup, filters, quality, secrets, language, decontamination, tokens.

Nothing else in the library imports this package. Every operator takes and returns DataFrames; the
thin registered queries that apply them to whole tables are in `plans`.
"""
