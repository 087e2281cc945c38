"""Structured Streaming forms of the batch operators.

The reference has no streaming; these reuse the batch parse/mask/count
operators on a growing directory of log files.
"""
