"""Operators for training data: consensus labels, varied subsets, percentiles, token ids, leakage, abusive language."""
