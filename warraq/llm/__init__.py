"""Operators for training data: consensus, repair, packing, mixing and review of texts.

Nothing outside this subpackage imports it.
"""
