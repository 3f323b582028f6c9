"""Relational operators and kernels on layers, memberships and ties."""
