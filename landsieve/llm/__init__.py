"""Operators for language-model training data: cleaning, de-duplication, tokens, packing, search and scoring."""
