"""Fixed tables and column functions."""
