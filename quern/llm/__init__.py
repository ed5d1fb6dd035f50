"""Operators for preparing training data: dedup, scoring, mixing, tokenising.

Nothing outside this subpackage imports it.  ``quern.llm.registry`` lists the
queries and their SQL oracles.
"""
