"""Where layers come from and results go."""
