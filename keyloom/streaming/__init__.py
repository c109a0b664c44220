"""Streaming use.

The library has no stateful stream operators. The row-local ones (predicates of ``operators.filters`` without
``opposite``, ``functions.scalar`` transforms and extractions, ``operators.filters.volcano``) take a streaming
DataFrame as they take a batch one; ``tests/test_streaming.py`` shows it.
"""
