"""Column functions: canonical spelling, deterministic hashing, formatting."""
