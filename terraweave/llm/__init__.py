"""Operators for preparing training data: matching, consensus, groups, tokens, packing and text quality."""
