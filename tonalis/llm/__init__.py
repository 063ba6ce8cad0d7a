"""Operators for preparing language-model training data at scale.

Nothing outside this folder imports it.  ``queries.py`` registers one query for
each operator; ``corpus_pipeline.py`` at the top of the repository chains five.
"""
