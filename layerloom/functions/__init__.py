"""Scalar building blocks: portable randomness, layer links, intervals."""
