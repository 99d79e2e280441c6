"""Structured Streaming jobs over file streams: indexing, request dedup, screening, totals, stage pairing, resume.

Micro-batches of one folder are ordered by file time; every job resumes from its checkpoint.
"""
