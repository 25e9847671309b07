"""Operators for preparing large text corpora for language-model training.

Nothing outside this subpackage imports it.  ``llm.catalog`` registers the
queries and their SQL; every other module holds one operator.
"""
