"""User-facing fits and study plans."""
