"""Training-data operators: decontamination, URL rules, language, PII, packing,
near-duplicates, repeated spans, quality, language model and outliers.

Nothing else in the library imports this subpackage.
"""
