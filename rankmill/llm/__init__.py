"""Operators for preparing and auditing text collections for language models.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""
