"""Operators for preparing language-model training data.

Nothing else in ``sievemill`` imports this subpackage; its queries are listed in
``sievemill.llm.registry``.
"""
