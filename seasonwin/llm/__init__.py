"""Operators for preparing language-model training data.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""
