"""Operators for preparing training text, each a DataFrame-to-DataFrame function.

Nothing else in ``vigil`` imports this subpackage; ``__spark_entry__`` adds its
queries only if it is there.
"""
