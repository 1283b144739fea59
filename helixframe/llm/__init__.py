"""Operators for preparing language-model training data.

Nothing outside this folder imports it; the entry module registers its queries only when it is present.
"""
