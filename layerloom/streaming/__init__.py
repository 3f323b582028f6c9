"""Layers as they arrive."""
