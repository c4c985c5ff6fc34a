"""Operators of a training-data pipeline: quality, decontamination, dedup, extraction, rules, tokens, toxicity, language."""
