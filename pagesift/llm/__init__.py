"""Operators for preparing training data.  Nothing outside this folder imports it.

``queries`` registers one query per operator; ``corpus_pipeline.py`` at the top of
the repository chains five of them.
"""
