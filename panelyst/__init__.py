"""Panel-survey analytics on Spark: linkage, recoding, scoring, tables and tests.

Every operator takes and returns a ``DataFrame`` and is written with column
expressions, so Catalyst sees the whole job.
"""
