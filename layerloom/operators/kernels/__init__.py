"""Graph kernels that work on one group in memory."""
