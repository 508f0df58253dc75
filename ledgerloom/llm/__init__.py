"""Operators for preparing language-model training corpora.

Nothing outside this folder imports it; the engine works with the folder removed.
"""
