"""Operators for training data: names, terms, pairs, linkage, tokens, packing, text quality."""
