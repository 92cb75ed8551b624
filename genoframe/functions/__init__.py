"""genoframe functions."""
